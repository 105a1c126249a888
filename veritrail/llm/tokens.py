"""Exact tokenizer calls with a bounded word memo, for use inside Spark tasks.

Both vocabularies cut a text at its spaces before anything else happens, so a
text's ids are the ids of its units laid end to end: a unit is a run of spaces
and line feeds with the run of other characters after it.  Most units of a
corpus come again and again; the memo keeps their ids as bytes, and a batch's
new units go to the tokenizers library together, in one string.

A text with white space other than space and line feed is given to the library
whole, since such characters could join two units in one token.
"""

from __future__ import annotations

import re
from itertools import filterfalse

import numpy as np

#: Begins a vocabulary's special tokens, which a unit that holds one may contain anywhere.
SPECIAL = "<|"
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space, by the reading of any regular-expression library, that is not space or line feed; and the memo's own mark.
_ODD_ASCII = "\t\r\x0b\x0c\x00\x1c\x1d\x1e\x1f"
_ODD_OTHER = "\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))


def _odd(text: str) -> bool:
    return any(c in text for c in _ODD_ASCII) or not text.isascii() and any(c in text for c in _ODD_OTHER)


def _runs(text: str) -> bool:
    """Whether ``str.split`` alone can't cut the text at its single spaces and line feeds."""
    return text[0] in " \n" or text[-1] in " \n" or any(run in text for run in ("  ", " \n", "\n ", "\n\n"))


#: Marks that no vocabulary here joins with letters before them.
_MARKS = "!#$%&*+,./:;<=>?@[]^_`{|}~()-\""
_MEMO_UNITS, _UNIT_CHARS, _JOINED = 600_000, 48, 2_000


class UnitEncoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to ``encode(text, add_special_tokens=False)``.

    The memo has two generations of at most ``_MEMO_UNITS`` units each and one
    text group, so its memory is bounded whatever the corpus; a unit of more
    than ``_UNIT_CHARS`` characters is never kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line_feed = (self.tokenizer.encode("\n", add_special_tokens=False).ids or [None])[0]
        ids = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", " A", "\nA")]
        #: Whether the vocabulary drops white space and case.
        self.loose = ids[0] == ids[1] == ids[2]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        if self.loose:
            self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    @staticmethod
    def _units(text: str) -> list[str]:
        """A text's units.  A word after one space stands without it; the first word has a mark instead."""
        if _runs(text):
            return ["\x00" + u for u in _UNIT.findall(text)]
        units = text.replace("\n", " \n").split(" ")
        units[0] = "\x00" + units[0]
        return units

    @staticmethod
    def _plain(unit: str) -> str:
        return unit[1:] if unit[:1] == "\x00" else unit if unit[:1] == "\n" else " " + unit

    def _learn(self, units: list[str]) -> None:
        """Give new units to the library, many in one string, and cut its ids apart again.

        A strict vocabulary has an id for the line feed between two units.  A
        loose one marks the ends of words, and a unit of letters alone or
        marks alone is one word.  Other units go one by one.
        """
        young = self.young
        alike = [u for u in units if "\n" not in u and (not self.loose or u.lstrip("\x00").lower().isalpha() or not u.strip(_MARKS))]
        for at in range(0, len(alike), _JOINED):
            some = alike[at : at + _JOINED]
            joined = self.tokenizer.encode_batch_fast([(" " if self.loose else "\n").join(map(self._plain, some))], add_special_tokens=False)[0]
            ids = np.asarray(joined.ids, dtype="<u4")
            if self.loose:
                ends, gap = (np.flatnonzero(self.ends_word[ids]) + 1).tolist(), 0
            else:
                ends, gap = np.flatnonzero(ids == self.line_feed).tolist() + [len(ids)], 1
            if len(ends) != len(some):
                young.update(zip(some, self._direct([self._plain(u) for u in some]), strict=True))
                continue
            raw, start = ids.tobytes(), 0
            for unit, end in zip(some, ends, strict=True):
                young[unit] = raw[4 * start : 4 * end]
                start = end + gap
        rest = list(set(units).difference(alike))
        if rest:
            young.update(zip(rest, self._direct([self._plain(u) for u in rest]), strict=True))

    def encode(self, texts: list[str | None], group_chars: int = 4_000_000) -> list[bytes]:
        """One bytes object per text; a null text is an empty one."""
        out: list[bytes] = [b""] * len(texts)
        group: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if _odd(text):
                out[i] = self._direct([text])[0]
                continue
            group.append((i, self._units(text)))
            size += len(text)
            if size >= group_chars:
                self._flush(group, out)
                group, size = [], 0
        self._flush(group, out)
        return out

    def _parts(self, unit: str) -> list[str]:
        """Units that give a new unit's ids, laid end to end: letters and the marks after them are always cut apart, a line feed stands alone, and a loose vocabulary needs no case or lead."""
        lead: list[str] = []
        if self.loose:
            unit = unit.lstrip("\x00\n") or unit
            if unit.isascii():
                unit = unit.lower()
        elif unit[0] == "\n":
            lead, unit = ["\x00\n"], "\x00" + unit[1:]
        core = unit.rstrip(_MARKS)
        if len(core) < len(unit) and core.lstrip("\x00").lower().isalpha():
            return [*lead, core, ("" if self.loose else "\x00") + unit[len(core) :]]
        return [*lead, unit]

    def _flush(self, group: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        young, old = self.young, self.old
        unknown: set[str] = set()
        for _, units in group:
            unknown.update(filterfalse(young.__contains__, units))
        large: list[str] = []
        made: list[tuple[str, list[str]]] = []
        fresh: set[str] = set()
        for unit in unknown:
            if unit in old:
                young[unit] = old[unit]
            elif len(unit) > _UNIT_CHARS or len(unit) < 2 or SPECIAL in unit:
                large.append(unit)
            else:
                parts = self._parts(unit)
                made.append((unit, parts))
                fresh.update(parts)
        # Only the few new units are looked up: ``difference_update`` would go through the whole memo.
        for unit in [u for u in fresh if u in young or u in old]:
            young.setdefault(unit, old.get(unit))
            fresh.discard(unit)
        self._learn(list(fresh))
        for unit, parts in made:
            young[unit] = young[parts[0]] if len(parts) == 1 else b"".join([young[x] for x in parts])
        if large:
            young.update(zip(large, self._direct([self._plain(u) for u in large]), strict=True))
        for i, units in group:
            out[i] = b"".join(map(young.__getitem__, units))
        for unit in large:
            del young[unit]
        if len(young) >= _MEMO_UNITS:
            self.old, self.young = young, {}


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The Python worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
