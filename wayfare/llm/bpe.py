"""Exact merge-type encoding by backtracking, and decoding, for SentencePiece BPE models.

Only the vocabulary (pieces, scores, kinds) is read from the model.  A text is cut where no piece can reach across.
Each unit is then covered from left to right by the longest piece that an Aho-Corasick automaton finds, provided that
it is compatible with the piece before it: merging the two anew from their characters must give the same two.  Where
no piece fits, the position's bit is set in a field of failed positions and the last piece is shortened.
"""

from __future__ import annotations

import functools

import ahocorasick

SPACE = "▁"


class MergeCodec:
    def __init__(self, model: bytes, cached_units: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.kind = {i: "control" for i in range(n) if sp.is_control(i)} | {i: "byte" for i in range(n) if sp.is_byte(i)}
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in self.kind.items() if k == "byte"}
        self.single = {p for p in self.ids if len(p) == 1}
        self.lines = not any("\n" in p for p in self.ids)  # no piece reaches across a line's end
        self.words = not any(p[k] != SPACE and p[k + 1] == SPACE for p in self.ids for k in range(len(p) - 1))
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # neighbours in pieces: elsewhere a text can be cut
        self.marks = "".join(m for m in map(chr, range(33, 127)) if not m.isalnum() and not any(q[1] == m and q[0].isalpha() for q in self.pairs))
        order = sorted({self.score[p] for p in self.ids if len(p) > 1}, reverse=True)
        place = {x: k for k, x in enumerate(order)}
        self.rank = [-1] * n  # of single characters; the others by score
        self.halves: list[tuple[int, int] | None] = [None] * n  # the last merge within a piece
        self.tied = set()
        by: dict[float, int] = {}
        self.links: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            last: list[str] = []
            if len(p) == 1 or self.merged(p, last) == [p]:  # others never stand in an encoding
                self.automaton.add_word(p, (len(p), i))
            if len(p) > 1:
                self.rank[i] = place[self.score[p]]
                self.halves[i] = (self.ids[last[0]], self.ids[last[1]]) if last and last[0] + last[1] == p and all(x in self.ids for x in last) else None
                if by.setdefault(self.score[p], i) != i:
                    self.tied |= {i, by[self.score[p]]}
        self.shorter = [-1] * n  # the longest other piece that a piece begins with
        for p in self.automaton.keys():
            self.shorter[self.ids[p]] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.automaton), -1)
        self.automaton.make_automaton()
        self.decimal = [str(i) for i in range(n)]
        self.said = {self.decimal[i]: "" if self.kind.get(i) == "control" else p.replace(SPACE, " ") for i, p in enumerate(self.pieces) if self.kind.get(i) != "byte" and i != self.unk}
        self.spaced = {self.decimal[i] for i, p in enumerate(self.pieces) if p.startswith(SPACE) and i not in self.kind}
        self.units: dict[str, str] = {}  # what was used of late; older: what was used before
        self.older: dict[str, str] = {}
        self.most = cached_units

    def merged(self, text: str, last: list[str] | None = None) -> list[str]:
        """Merges neighbours, the best score first and the leftmost of equals, until none can be; last: gets the last two."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            if last is not None:
                last[:] = parts[at : at + 2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.links.get(key)
        if found is None:
            if len(self.links) >= 4 * self.most:
                self.links.clear()
            found = self.links[key] = self._agree(a, b)
        return found

    def _agree(self, a: int, b: int) -> bool:
        """Undoes the merges within both, the latest first, and looks for an earlier merge of what then touches."""
        pieces, ids, rank, halves, tied = self.pieces, self.ids, self.rank, self.halves, self.tied
        limit, x, y = len(pieces), a, b
        while True:
            both = ids.get(pieces[x] + pieces[y])
            if both is not None and rank[both] < limit:
                return False
            if x in tied or y in tied or both in tied:
                break  # equal scores: which comes first depends on the place
            left = rank[x] > rank[y]
            if rank[x] < 0 and rank[y] < 0:
                return True
            if left:
                if halves[x] is None:
                    break
                limit, x = rank[x], halves[x][1]
            else:
                if halves[y] is None:
                    break
                limit, y = rank[y] + 1, halves[y][0]
        return self.merged(pieces[a] + pieces[b]) == [pieces[a], pieces[b]]

    def covered(self, run: str) -> list[int]:
        """Encodes a run of characters that are all in the vocabulary."""
        # the longest matches one after the other; there is one encoding only, so this is it if all neighbours agree
        out: list[int] = []
        size, last, links = 0, -1, self.links
        for _, (k, i) in self.automaton.iter_long(run):
            size += k
            if last >= 0:
                ok = links.get(last << 20 | i)
                if not (self.compatible(last, i) if ok is None else ok):
                    return self.backtracked(run)
            out.append(i)
            last = i
        return out if size == len(run) else self.backtracked(run)

    def backtracked(self, run: str) -> list[int]:
        n, pieces, shorter, compatible = len(run), self.pieces, self.shorter, self.compatible
        longest = [-1] * n
        for end, (k, i) in self.automaton.iter(run):
            longest[end - k + 1] = i  # matches come in the order of their ends, so the longest of a start is the last
        out: list[int] = []
        where: list[int] = []  # starts of the pieces in out
        failed = 0
        pos, i = 0, longest[0]
        while True:
            while i >= 0:
                end = pos + len(pieces[i])
                if not failed >> end & 1 and (not out or compatible(out[-1], i)):
                    break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                where.append(pos)
                if end == n:
                    return out
                pos, i = end, longest[end]
                continue
            failed |= 1 << pos
            if not out:
                raise ValueError(f"no encoding of {run!r}")
            pos = where.pop()
            i = shorter[out.pop()]

    def encode_unit(self, unit: str) -> list[int]:
        if self.single.issuperset(unit):
            return self.covered(unit)
        out: list[int] = []
        start = 0
        for k, c in enumerate(unit):
            if c not in self.single:
                if start < k:
                    out += self.covered(unit[start:k])
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unk]
                start = k + 1
        if start < len(unit):
            out += self.covered(unit[start:])
        return out

    def unit(self, unit: str) -> str:
        """Ids in decimal, joined by spaces, kept for the next time."""
        found = self.units.get(unit)
        if found is not None:
            return found
        stem = unit.rstrip(self.marks)
        if stem and len(stem) < len(unit) and unit[len(stem) - 1 : len(stem) + 1] not in self.pairs:
            return f"{self.unit(stem)} {self.unit(unit[len(stem) :])}"
        found = self.older.get(unit)
        if found is None:
            decimal = self.decimal
            found = " ".join([decimal[i] for i in self.encode_unit(unit)])
        if len(unit) < 100:
            if len(self.units) >= self.most:
                self.older, self.units = self.units, {}
            self.units[unit] = found
        return found

    def split(self, text: str) -> list[str]:
        """Units of a text, with spaces as U+2581 and one more in front."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.words:
            return [(" " + text).replace(" ", SPACE)]
        out: list[str] = []
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            if k:
                out.append("\n")
            words = (" " + line if not k else line).split(" ")
            if words[0]:
                out.append(words[0])
            gap = SPACE
            for w in words[1:]:
                if w:
                    out.append(gap + w)
                    gap = SPACE
                else:
                    gap += SPACE
            if len(gap) > 1:
                out.append(gap[1:])
        return out

    def encode(self, text: str) -> list[int]:
        """All ids, with the end id last."""
        return [int(i) for i in self.codes(text).split(" ")]

    def codes(self, text: str | None) -> str:
        """All ids in decimal, joined by spaces, with the end id last; a missing text is an empty one."""
        get, unit = self.units.get, self.unit
        return " ".join([*[get(u) or unit(u) for u in self.split(text or "")], self.decimal[self.eos]])

    def raw(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            kind = self.kind.get(i)
            if kind == "byte":
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(_text(bytes(run)))
                run.clear()
            if kind is None:
                out.append(" ⁇ " if i == self.unk else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_text(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, and so does the space that encoding puts in front."""
        text = self.raw(ids)
        first = next((i for i in ids if self.kind.get(i) != "control"), None)
        return text[1:] if first is not None and self.kind.get(first) is None and self.pieces[first].startswith(SPACE) else text

    def decode_codes(self, codes: str) -> str:
        """The text of ids in decimal, joined by spaces: by a table where all of them are plain pieces or control ids."""
        parts = codes.split(" ")
        try:
            text = "".join(map(self.said.__getitem__, parts))
        except KeyError:
            return self.decode([int(i) for i in parts if i])
        return text[1:] if parts[0] in self.spaced else text


def _text(run: bytes) -> str:
    """Each byte that is no part of a character becomes one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[k : k + size].decode())
                    k += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@functools.lru_cache(maxsize=2)
def codec(model: bytes) -> MergeCodec:
    """One for each Python worker, which serves many tasks."""
    return MergeCodec(model)
