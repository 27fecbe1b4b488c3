"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word exactly one token can be the last one of its BPE encoding: among the
vocabulary entries that end there (found by a suffix automaton of the vocabulary, whose steps are filled in as they are met) the one that is
compatible with the last token of the prefix before it. Two neighbouring tokens are compatible
when BPE merging of their joined text gives back those two tokens. Storing that token for every
prefix and following the back-pointers from the end gives exactly the ids that merging gives.

The vocabulary (a tokenizer JSON file of bounded size, read by the driver) is broadcast; the
automaton, the pair tests and the words already encoded are kept per Python worker, bounded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from textpulse.llm.text import as_str, id_and_text, id_type, slices
from textpulse.llm.words import WordCutter, char_classes

#: Largest tokenizer file that is broadcast.
MAX_MODEL_BYTES = 64 << 20
#: Words (twice: recent and older ones) and token pairs remembered by one worker.
MAX_WORDS = 150_000
MAX_PAIRS = 500_000
NEVER = float("inf")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next character from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: Settings that change ids or texts and that this encoder doesn't have: those of the model and of
#: its added tokens (a token's ``normalized`` changes nothing, as there is no normalizer).
_UNSUPPORTED_MODEL = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
_UNSUPPORTED_TOKEN = ("single_word", "lstrip", "rstrip")


class Bpe:
    """One byte-level BPE tokenizer; pickled as its file's text, compiled on first use in a worker."""

    def __init__(self, source: str, classes: bytes):
        self.source, self.classes = source, classes
        self._ready = False

    def __getstate__(self):
        return {"source": self.source, "classes": self.classes, "_ready": False}

    def compile(self) -> Bpe:
        if self._ready:
            return self
        spec = json.loads(self.source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE tokenizers without normalizer and prefix space are supported")
        unsupported = [name for name in _UNSUPPORTED_MODEL if model.get(name)]
        unsupported += sorted({name for t in spec.get("added_tokens") or [] for name in _UNSUPPORTED_TOKEN if t.get(name)})
        if (spec.get("decoder") or {}).get("type") != "ByteLevel":
            unsupported.append("decoder")
        if unsupported:
            raise ValueError(f"unsupported tokenizer settings: {', '.join(unsupported)}")
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.made_of = {made: (rank, pair) for pair, (rank, made) in self.merges.items()}
        if len(self.made_of) < len(self.merges):
            raise ValueError("two merges make the same token")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.chars = byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        self.token_text = {i: t for t, i in self.ids.items()}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in self.ids.items() if t not in self.special}
        self.token_bytes.update({i: t.encode() for t, i in self.special.items()})
        self.lengths = [0] * (max(self.token_bytes) + 1)
        for t, i in self.ids.items():
            self.lengths[i] = len(t)
        #: Nodes of the suffix automaton: every prefix of a vocabulary entry, the root first.
        prefixes = {t[:k] for t in self.ids if t not in self.special for k in range(1, len(t) + 1)}
        self.node_text = ["", *prefixes]
        self.node_of = {t: k for k, t in enumerate(self.node_text)}
        self.steps: dict[int, int] = {}
        self.ends: list[list[tuple[int, int]] | None] = [None] * len(self.node_text)
        self.cutter = WordCutter(self.classes, tuple(self.special))
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.older: dict[str, tuple[str, tuple[int, ...]]] = {}
        self._ready = True
        return self

    def merged(self, text: str) -> list[int]:
        """BPE by repeated merging of the best-ranked pair; used on single tokens' text only."""
        ids = [self.ids[c] for c in text]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at one end of a token while it is merged together: (piece, rank
        of the merge that swallows it), from a single byte to the token. side: 0 left, 1 right."""
        known = self.edges[side].get(token)
        if known is None:
            known, rank = [], NEVER
            while True:
                known.append((token, rank))
                if token not in self.made_of:
                    break
                rank, pair = self.made_of[token]
                token = pair[side]
            known.reverse()
            self.edges[side][known[-1][0]] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: may begin a word) in a BPE encoding.

        Both tokens grow by their own merges. While two pieces stand at the border, their own
        pair is merged across it if that ranks before the merges that swallow either piece
        (equal ranks go from left to right).
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) >= MAX_PAIRS:
            self.fits.clear()
        if left < 0:
            known = self.merged(self.token_text[right]) == [right]
        else:
            a, b, i, j, known = self.edge(left, 1), self.edge(right, 0), 0, 0, None
            while known is None:
                (x, until_x), (y, until_y) = a[i], b[j]
                across = self.merges.get((x, y))
                if across and across[0] < until_x and across[0] <= until_y:
                    known = False
                elif until_x == until_y == NEVER:
                    known = True
                elif until_x <= until_y:
                    i += 1
                else:
                    j += 1
        self.fits[key] = known
        return known

    def step(self, node: int, byte: int) -> int:
        """The suffix automaton's next node: the longest vocabulary prefix that ends here."""
        text = self.node_text[node] + self.chars[byte]
        while text not in self.node_of:
            text = text[1:]
        found = self.steps[node << 8 | byte] = self.node_of[text]
        if self.ends[found] is None:
            tails = (text[k:] for k in range(len(text)))
            self.ends[found] = [(self.ids[t], len(t)) for t in tails if t in self.ids and t not in self.special]
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word: the unique last token of every prefix, then the back-pointers."""
        node, last, n, fits, steps, ends = 0, [-1], 1, self.fits, self.steps, self.ends
        for byte in word.encode("utf-8", "surrogatepass"):
            node = steps.get(node << 8 | byte) or self.step(node, byte)
            for token, length in ends[node]:
                left = last[n - length]
                fit = fits.get((left, token))
                if fit or fit is None and self.compatible(left, token):
                    last.append(token)
                    break
            n += 1
        ids, lengths, n = [], self.lengths, n - 1
        while n:
            token = last[n]
            ids.append(token)
            n -= lengths[token]
        ids.reverse()
        return ids

    def learn(self, word: str) -> tuple[str, tuple[int, ...]]:
        """Encode a word that is not among the recent ones, and remember it."""
        entry = self.known.get(word) or self.older.get(word)
        if entry is None:
            ids = [self.special[word]] if word in self.special else self.encode_word(word)
            entry = (",".join(map(str, ids)), tuple(ids))
        if len(word) <= 64:
            if len(self.known) >= MAX_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = entry
        return entry

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """All ids of each text, and the same joined by commas."""
        words, bounds = self.cutter.words(texts)
        found = list(map(self.known.get, words))
        if None in found:
            found = [entry or self.learn(word) for word, entry in zip(words, found, strict=True)]
        bounds = bounds.tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            entries = found[a:b]
            yield list(chain.from_iterable([ids for _, ids in entries])), ",".join([joined for joined, _ in entries])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def load_bpe(path: str) -> Bpe:
    """Read a tokenizer file on the driver, checking the size that will be broadcast."""
    with open(path, encoding="utf-8") as f:
        source = f.read(MAX_MODEL_BYTES + 1)
    if len(source) > MAX_MODEL_BYTES:
        raise ValueError(f"tokenizer file is larger than {MAX_MODEL_BYTES} characters")
    bpe = Bpe(source, char_classes())
    bpe.compile()  # report an unsupported file here, not in a task
    return bpe


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return both digests.

    Columns: the identifier, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded text in UTF-8) and, if ``with_ids``, ``ids``
    (array<int>). One row out per row in, map-only: null or empty texts give no ids (digests of
    the empty string), repeated rows and null identifiers are kept, other columns are ignored.
    A text of any length is encoded word by word; special tokens in a text become their ids.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(load_bpe(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocab.value.compile()
        for batch in slices(batches, 1, 1 << 20):
            counts, id_digests, text_digests, all_ids = [], [], [], []
            for ids, joined in bpe.encode(as_str(batch.column(1))):
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                text_digests.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
