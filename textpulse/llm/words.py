"""Cutting texts into the words of a byte-level tokenizer, by a finite-state machine.

The machine reads one symbol per character (its class and what follows it) and marks word starts.
Texts are cut into chunks of equal length; each chunk's map from every entry state to its exit
state is found for all chunks side by side, the maps are composed by a parallel prefix scan, and
a second walk over the chunks, now from known entry states, gives the marks.
"""

from __future__ import annotations

import re

import numpy as np

CHUNK = 64

# Character classes.
_OTHER, _LETTER, _DIGIT, _BLANK, _SPACE = range(5)
# Symbols: classes, white space by what follows it, an apostrophe that may open a contraction of
# one or two letters, and the end of a text.
_S_OTHER, _S_LETTER, _S_DIGIT, _S_BLANK_LAST, _S_SPACE_LAST, _S_WHITE, _S_SHORT, _S_LONG, _S_END = range(9)
# States: at a text's start, inside a run of a class, after the blank that opens a word, inside
# white space, with letters of a contraction to come, and after a contraction.
_START, _IN_OTHER, _IN_LETTER, _IN_DIGIT, _OPENED, _IN_WHITE, _ONE_LEFT, _TWO_LEFT, _CLOSED = range(9)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, word starts here) by [state, symbol]."""
    step = np.zeros((9, 9), np.uint8)
    mark = np.zeros((9, 9), bool)
    runs = {_S_OTHER: _IN_OTHER, _S_LETTER: _IN_LETTER, _S_DIGIT: _IN_DIGIT}
    for state in range(9):
        for symbol in range(9):
            if state in (_ONE_LEFT, _TWO_LEFT) and symbol == _S_LETTER:
                step[state, symbol], mark[state, symbol] = (_CLOSED if state == _ONE_LEFT else _ONE_LEFT), False
            elif symbol == _S_END:
                step[state, symbol] = _START
            elif symbol in (_S_SHORT, _S_LONG) and state not in (_IN_OTHER, _OPENED):
                step[state, symbol], mark[state, symbol] = (_ONE_LEFT if symbol == _S_SHORT else _TWO_LEFT), True
            elif symbol == _S_BLANK_LAST:  # a blank before a word belongs to it
                step[state, symbol], mark[state, symbol] = _OPENED, True
            elif symbol == _S_SPACE_LAST:  # the last of white space stands alone
                step[state, symbol], mark[state, symbol] = _CLOSED, True
            elif symbol == _S_WHITE:
                step[state, symbol], mark[state, symbol] = _IN_WHITE, state != _IN_WHITE
            else:
                run = runs.get(symbol, _IN_OTHER)
                step[state, symbol], mark[state, symbol] = run, state not in (run, _OPENED)
    return step, mark


def char_classes() -> bytes:
    """The class of every code point, as the installed tokenizers library has it.

    Unicode versions differ between libraries, so the letters and digits that the ``regex``
    library knows are confirmed by the tokenizer library's own word splitting: a letter (digit)
    is what it joins to a letter (digit) before it.
    """
    import regex
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for lead, pattern, kind in (("a", r"\p{L}", _LETTER), ("1", r"\p{N}", _DIGIT)):
        codes = list(map(ord, regex.findall(pattern, every)))
        for part in (codes[k : k + 4096] for k in range(0, len(codes), 4096)):
            starts = {span[0] for _, span in split.pre_tokenize_str("".join(lead + chr(c) for c in part))}
            out[[c for k, c in enumerate(part) if 2 * k + 1 not in starts]] = kind
    for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):  # White_Space
        out[c] = _SPACE
    out[ord(" ")] = _BLANK
    return out.tobytes()


class WordCutter:
    """Word starts of many texts at once, by chunk state maps and a prefix scan."""

    def __init__(self, classes: bytes, specials: tuple[str, ...] = ()):
        self.classes = np.frombuffer(classes, np.uint8)
        self.specials = re.compile("|".join(re.escape(t) for t in sorted(specials, key=len, reverse=True))) if specials else None
        self.step, self.mark = _machine()

    def symbols(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One symbol per character; ``ends`` are the positions of the separators."""
        n = len(codes)
        kind = self.classes[codes]
        white = (kind == _BLANK) | (kind == _SPACE)
        end = np.zeros(n + 3, bool)
        end[ends] = True
        end[n:] = True
        next_word = np.zeros(n, bool)
        next_word[:-1] = ~white[1:] & ~end[1:n]
        out = np.select([kind == _LETTER, kind == _DIGIT, kind == _BLANK, kind == _SPACE], [_S_LETTER, _S_DIGIT, _S_BLANK_LAST, _S_SPACE_LAST], _S_OTHER).astype(np.uint8)
        out[white & ~next_word] = _S_WHITE
        quotes = np.flatnonzero(codes == ord("'"))
        if len(quotes):
            padded = np.concatenate((codes, np.zeros(2, codes.dtype)))
            padded[np.flatnonzero(end[:n])] = 0
            a, b = padded[quotes + 1], padded[quotes + 2]
            out[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = _S_SHORT
            out[quotes[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = _S_LONG
        out[ends] = _S_END
        return out

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a word starts at each position."""
        n = len(symbols)
        chunks = -(-n // CHUNK)
        table = np.full(chunks * CHUNK, _S_END, np.uint8)
        table[:n] = symbols
        table = np.ascontiguousarray(table.reshape(chunks, CHUNK).T)  # one row per place in a chunk
        maps = np.tile(np.arange(9, dtype=np.uint8), (chunks, 1))
        for row in table:
            maps = self.step[maps, row[:, None]]
        reach = 1
        while reach < chunks:  # inclusive scan: maps[k] becomes the map of chunks 0..k
            later = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), axis=1)
            maps = np.concatenate((maps[:reach], later))
            reach *= 2
        state = np.concatenate(([_START], maps[:-1, _START])).astype(np.uint8)
        marks = np.empty((CHUNK, chunks), bool)
        for k, row in enumerate(table):
            marks[k] = self.mark[state, row]
            state = self.step[state, row]
        return marks.T.reshape(-1)[:n]

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all texts, and where each text's words begin in that list (one more at the
        end). A special token in a text is one word and ends the words around it."""
        pieces, special, last = [], [], []
        for text in texts:
            at = 0
            for m in self.specials.finditer(text) if self.specials else ():
                pieces += (text[at : m.start()], m[0])
                special.append(len(pieces) - 1)
                at = m.end()
            pieces.append(text[at:])
            last.append(len(pieces) - 1)
        if not pieces:
            return [], np.zeros(1, np.int64)
        whole = "\n".join([*pieces, ""])
        ends = np.cumsum(np.array([len(p) + 1 for p in pieces], np.int64)) - 1
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self.starts(self.symbols(codes, ends))
        for k in special:
            starts[ends[k] - len(pieces[k]) : ends[k]] = False
            starts[ends[k] - len(pieces[k])] = True
        starts[ends] = True  # a separator closes the last word; it is no word itself
        at = np.flatnonzero(starts)
        real = np.ones(len(codes), bool)
        real[ends] = False
        first, stop = at[:-1][real[at[:-1]]], at[1:][real[at[:-1]]]
        words = [whole[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
        return words, np.concatenate(([0], np.searchsorted(first, ends[last])))
