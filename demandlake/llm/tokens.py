"""Token ids of texts: each distinct word is encoded once by a worker, which keeps the frequent ones in mind."""

from __future__ import annotations

import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KNOWN = 600_000  # chunks, and as many words, that a worker remembers; beyond, it keeps the more frequent half
TEXTS = 512  # texts that are encoded together
LOT = 400  # new words that are encoded as one text
PART_CHARS = 1 << 20  # a longer text is encoded in parts
#: How the tokenizer cuts a lower-cased text of the letters below into words.
WORDS = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+)"
#: An empty chunk, or one with any other character or the start of a special token, is left to the tokenizer whole.
OTHER = r"^$|[^\x21-\x7eÀ-ÖØ-öø-ÿ]|<\|"


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each span, one span after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Memory:
    """Strings numbered in the order they come, with the ids of each and how often it was asked for."""

    def __init__(self):
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids = np.empty(0, np.uint32)
        self.starts, self.sizes, self.used = (np.empty(0, np.int64) for _ in range(3))

    def numbers(self, strings: Iterable[str], n: int) -> tuple[np.ndarray, list[str]]:
        """Their numbers, and the strings that are new: ``learn`` must get the ids of those next."""
        known = len(self.index)
        found = np.fromiter(map(self.index.__getitem__, strings), np.int64, n)
        return found, list(itertools.islice(reversed(self.index), len(self.index) - known))[::-1]

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the new strings, one after another."""
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.used = np.append(self.used, np.zeros(len(sizes), np.int64))
        self.ids = np.append(self.ids, ids)

    def recall(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings of these numbers one after another, and how many each has."""
        sizes = self.sizes[numbers]
        self.used += np.bincount(numbers, minlength=len(self.used))
        return self.ids[spans(self.starts[numbers], sizes)], sizes

    def shrink(self, most: int) -> None:
        """Beyond ``most`` strings, keep the half that was asked for most; older uses count half from then on."""
        if len(self.index) <= most:
            return
        kept = np.sort(np.argsort(-self.used, kind="stable")[: most // 2])
        strings = list(self.index)
        ids, sizes = self.ids[spans(self.starts[kept], self.sizes[kept])], self.sizes[kept]
        used = self.used[kept] // 2
        self.__init__()
        for i in kept.tolist():
            self.index[strings[i]]
        self.learn(ids, sizes)
        self.used = used


class Loaded(dict):
    """Encoders of one process; a copy, as goes out with the class, is empty."""

    def __reduce__(self):
        return Loaded, ()


class Encoder:
    """A tokenizer that lower-cases, drops white space and marks word ends, with a memory of words.

    Such a tokenizer never joins what white space parts, so a text's ids are those of its chunks in
    turn, and each distinct chunk is encoded once. Chunks of plain letters are cut into words; new
    words are encoded many at a time and told apart by the word-end mark.
    """

    _loaded: dict[str, Encoder] = Loaded()

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.path, self.chunks, self.words = path, Memory(), Memory()

    def __reduce__(self):
        return Encoder.load, (self.path,)  # a copy learns anew

    @classmethod
    def load(cls, path: str) -> Encoder:
        """The encoder of this worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encode(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn_words(self, new: list[str]) -> None:
        lots = [new[i : i + LOT] for i in range(0, len(new), LOT)]
        ids, sizes = [], []
        for lot, found in zip(lots, self._encode([" ".join(x) for x in lots]), strict=True):
            size = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
            if len(size) != len(lot) or size.sum() != len(found):  # a word without, or with a second, end mark
                each = self._encode(lot)
                found, size = np.concatenate(each), np.array([len(x) for x in each])
            ids.append(found)
            sizes.append(size)
        if new:
            self.words.learn(np.concatenate(ids), np.concatenate(sizes))

    def _learn_chunks(self, strings: list[str]) -> None:
        new = pa.array(strings, pa.string())
        other = pc.match_substring_regex(new, OTHER)
        marked = pc.replace_substring_regex(pc.utf8_lower(new.filter(pc.invert(other))), WORDS, r"\1 ")
        counts = pc.count_substring(marked, " ").to_numpy()
        together = pc.binary_join(pa.ListArray.from_arrays([0, len(marked)], marked), "")
        words = together[0].as_py().split(" ")[:-1]  # each is followed by a space
        numbers, new_words = self.words.numbers(words, len(words))
        self._learn_words(new_words)
        ids, sizes = self.words.recall(numbers)
        other = other.to_numpy(zero_copy_only=False)
        per_chunk = np.zeros(len(new), np.int64)
        per_chunk[~other] = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))])
        at = np.flatnonzero(other)
        if len(at):  # put the ids of chunks that were encoded whole between those of the others
            whole = self._encode(new.filter(pa.array(other)).to_pylist())
            before = (np.cumsum(per_chunk) - per_chunk)[at]
            ids = np.insert(ids, np.repeat(before, [len(x) for x in whole]), np.concatenate(whole))
            per_chunk[at] = [len(x) for x in whole]
        self.chunks.learn(ids, per_chunk)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        self.chunks.shrink(KNOWN)
        self.words.shrink(KNOWN)
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        numbers, new = self.chunks.numbers(itertools.chain.from_iterable(parts), int(counts.sum()))
        if new:
            self._learn_chunks(new)
        ids, sizes = self.chunks.recall(numbers)
        return np.split(ids, np.append(0, np.cumsum(sizes))[np.cumsum(counts)][:-1])

    def encode_text(self, text: str) -> np.ndarray:
        """Ids of one text, however long: parts end at spaces."""
        found, at = [], 0
        while True:
            end = text.find(" ", at + PART_CHARS)
            if end < 0:
                return np.concatenate([*found, *self.encode([text[at:]])])
            found += self.encode([text[at:end]])
            at = end


def cut_documents(docs: DataFrame, tokenizer: str, length: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): ids of documents (doc_id, text), each
    ended by ``end_id``, in pieces of ``length`` and a rest. ``ids`` are little-endian 32-bit numbers."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    end = np.array([end_id], np.uint32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        for batch in batches:
            doc_ids, values = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            for at in range(0, len(doc_ids), TEXTS):
                rows, some = [], values.slice(at, TEXTS).to_pylist()
                short = [v for v in some if len(v) <= PART_CHARS]
                encoded = iter(encoder.encode(short) if short else [])
                for doc_id, text in zip(doc_ids[at : at + TEXTS], some, strict=True):
                    ids = np.append(next(encoded) if len(text) <= PART_CHARS else encoder.encode_text(text), end)
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length].tobytes()
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece))
                cols = list(zip(*rows, strict=True))[: 6 if with_ids else 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.binary()) for c in cols[5:]],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
