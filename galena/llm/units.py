"""Tokenising by memo: a text is cut where no token can cross, and each distinct unit is encoded once per task.

The byte-level split pattern takes one blank along with the visible characters after it. A blank between two visible
characters is therefore always the first character of a match, and the match before it ends there; neither side sees
the other. Texts are cut at those blanks only. A text with any other kind of blank neighbourhood (runs of blanks, a
blank beside a line break) goes to the encoder whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Units that one task remembers (some 200 bytes each, so 60 MB), and the longest that it remembers, in characters.
MEMO_UNITS, MEMO_CHARS = 300_000, 48


class UnitMemo:
    """Maps texts to packed ids (little-endian unsigned 32-bit), remembering units.

    A memo belongs to one task: workers outlive tasks, and what they remember would add up over the stages of a job.

    encode_many takes a list of strings and returns their packed ids; it has to give the same ids for a text as for
    its units one after the other when cut at single blanks between visible characters. encode_units does the same for
    strings that are all units: a blank, then characters of which the first and the last are visible.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], encode_units: Callable[[list[str]], Iterable[bytes]] | None = None, units: int = MEMO_UNITS):
        self.encode_many, self.encode_units, self.units = encode_many, encode_units or encode_many, units
        self.tails: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text. What the memo lacks for all of them is encoded in one go."""
        cut = [t.split(" ") for t in texts]
        need = set().union(*cut) if cut else set()
        if len(self.tails) + len(self.older) > self.units:  # what is in use comes back from the older half
            self.older, self.tails = self.tails, {}
        tails, older = self.tails, self.older
        need.difference_update(tails)
        own = {p: older[p] for p in need & older.keys()} if older else {}
        need.difference_update(own)
        plain = [p for p in need if p and not (p[0].isspace() or p[-1].isspace())]
        own.update(dict.fromkeys(need))
        own.update(zip(plain, self.encode_units([" " + p for p in plain]), strict=True))
        long = {p: own.pop(p) for p in [p for p in own if len(p) > MEMO_CHARS]}
        tails.update(own)
        out: list = [None] * len(texts)
        heads, wholes = [], []
        for i, (first, *parts) in enumerate(cut):
            found = [long[p] if p in long else tails[p] for p in parts] if long else list(map(tails.__getitem__, parts))
            if None in found or first[-1:].isspace() or not first:
                wholes.append(i)
            else:
                out[i] = b"".join(found)
                heads.append(i)
        for i, x in zip(heads, self.encode_many([cut[i][0] for i in heads]), strict=True):
            out[i] = x + out[i]
        for i in wholes:
            out[i] = next(iter(self.encode_many([texts[i]])))
        return out
