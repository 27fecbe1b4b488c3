"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic machines read a text. The first (``words.py``) cuts
it into words: chunks of characters become state maps, composed by a parallel prefix scan.

The second machine reads a word's bytes. Its state is all that can matter for the rest of the
word: the longest vocabulary prefix that ends here, and the last token and relative token count
of each prefix inside it. Transitions carry the number of tokens they emit, the state the number
still to come, so a word's count is a sum over its path. States and transitions are compiled
when they are first met, and whole words are remembered as single steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textpulse.llm.bpe import Bpe, load_bpe
from textpulse.llm.text import as_str, id_and_text, id_type, slices

MAX_STATES = 400_000
MAX_WORDS = 300_000

class CountTransducer:
    """The number of tokens of a word, by a transducer that is compiled as words are read."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[int, tuple[int, ...], tuple[int, ...]]] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self.start = self._number((0, (-1,), (0,)))

    def _number(self, state: tuple) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of ``state`` on ``byte``: (next state, tokens emitted)."""
        bpe = self.bpe
        node, last, counts = self.states[state]
        after = bpe.steps.get(node << 8 | byte) or bpe.step(node, byte)
        for token, length in bpe.ends[after]:
            if bpe.compatible(last[-length], token):
                last, counts = (*last, token), (*counts, counts[-length] + 1)
                break
        keep = len(bpe.node_text[after]) + 1
        last, counts = last[-keep:], counts[-keep:]
        emitted = counts[0]
        found = self.steps[state << 8 | byte] = (self._number((after, last, tuple(c - emitted for c in counts))), emitted)
        return found

    def count(self, word: str) -> int:
        state, total, steps = self.start, 0, self.steps
        for byte in word.encode("utf-8", "surrogatepass"):
            step = steps.get(state << 8 | byte)
            if step is None:
                if len(self.states) > MAX_STATES:  # forget all but where the word is
                    here = self.states[state]
                    self._reset()
                    state, steps = self._number(here), self.steps
                step = self._compile(state, byte)
            state, emitted = step
            total += emitted
        return total + self.states[state][2][-1]


class Counter:
    """Counts the tokens of a batch of texts; one per Python worker."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe.compile()
        self.transducer = CountTransducer(self.bpe)
        self.words: dict[str, int] = {}

    def learn(self, word: str) -> int:
        count = 1 if word in self.bpe.special else self.transducer.count(word)
        if len(word) <= 64:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            self.words[word] = count
        return count

    def totals(self, texts: list[str]) -> np.ndarray:
        words, bounds = self.bpe.cutter.words(texts)
        counts = list(map(self.words.get, words))
        if None in counts:
            known = self.words.get
            counts = [c if c is not None else known(w) or self.learn(w) for w, c in zip(words, counts, strict=True)]
        sums = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))
        return np.diff(sums[bounds])


class SharedCounter:
    """The broadcast form: the tokenizer's text, compiled once in each worker."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.counter = bpe, None

    def __getstate__(self):
        return {"bpe": self.bpe, "counter": None}

    def get(self) -> Counter:
        if self.counter is None:
            self.counter = Counter(self.bpe)
        return self.counter


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``; map-only.

    Null and empty texts have no tokens; special tokens in a text count as one each; repeated
    rows and null identifiers are kept, other columns are ignored. A text of any length is one
    run of chunks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(SharedCounter(load_bpe(tokenizer_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value.get()
        for batch in slices(batches, 1, 2 << 20):
            totals = counter.totals(as_str(batch.column(1)))
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(totals, pa.int64()), pa.array(totals > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean")
