"""A SentencePiece BPE model with byte fallback as tables, for the transducer and the lattice.

BPE over scores is decided pair by pair: a sequence of pieces is what the merges give if and only if each adjacent pair
is, and a pair holds unless some merge across its border would have come before the merges that built both sides. So
each piece carries its right and left spine: the parts that at some time end (begin) at the border, with the rank of the
merge that ends that time. Runs of spaces have pieces of one common, lowest score; they are settled by run length.
"""

from __future__ import annotations

from functools import lru_cache

SPACE = "▁"
INF = 1 << 40


class Pieces:
    """ids, ranks and spines of the pieces that merges can give."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        text = [m.id_to_piece(i) for i in range(n)]
        self.path = path
        self.byte = [-1] * 256
        plain: list[tuple[float, int, str]] = []
        for i, p in enumerate(text):
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and (len(p) == 1 or p.strip(SPACE)):
                plain.append((-m.get_score(i), i, p))
        self.rank = {p: r + 1 for r, (_, _, p) in enumerate(sorted(plain))}
        self.id = {p: i for _, i, p in plain}
        self.text = text
        if any(SPACE in p[1:] for p in self.id):
            raise ValueError("a piece goes over a space: words can't be settled one by one")
        chars = {p for p in self.id if len(p) == 1}
        if any(set(p) - chars for p in self.id):
            raise ValueError("a piece holds a character that is no piece")
        self.parts: dict[str, tuple[str, str] | None] = {}
        for p in sorted(self.id, key=len):
            got = None if len(p) == 1 else self._last_merge(p)
            if got != ():
                self.parts[p] = got
        self.longest = max(map(len, self.parts))
        self.right = {p: self._spine(p, 1) for p in self.parts}
        self.left = {p: self._spine(p, 0) for p in self.parts}

    def _last_merge(self, p: str):
        """The two parts whose merge gives p, or () where merges don't give p."""
        s = list(p)
        while len(s) > 2:
            best = min(((self.rank.get(a + b, INF), i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False))), default=(INF, 0))
            if best[0] == INF:
                return ()
            i = best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return (s[0], s[1]) if self.rank.get(s[0] + s[1]) else ()

    def _spine(self, p: str, side: int) -> list[tuple[int, int, int]]:
        """(length, rank of its own merge, rank of the merge that takes it) from the whole piece inwards."""
        out, taken = [], INF
        while True:
            parts = self.parts.get(p)
            own = self.rank[p] if parts else 0
            out.append((len(p), own, taken))
            if not parts:
                return out
            taken, p = own, parts[side]

    def holds(self, u: str, v: str) -> bool:
        """Whether merges leave the border between the pieces u and v."""
        for la, own_a, end_a in self.right[u]:
            for lb, own_b, end_b in self.left[v]:
                r = self.rank.get(u[len(u) - la :] + v[:lb])
                if r is not None and r < end_a and r <= end_b and own_a < end_a and max(own_a, own_b) <= min(end_a, end_b):
                    return False
        return True


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=4)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=100_000)
def run_ids(path: str, n: int) -> tuple[int, ...]:
    """Pieces of n spaces that stand by themselves (the model puts one of them in front itself)."""
    return tuple(library(path).encode(" " * (n - 1))) if n > 1 else (library(path).piece_to_id(SPACE),) if n else ()
