"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

    align(docs, a_path, b_path)   # doc_id, n_a, n_b, n_groups, groups, pairs, counts
    best(aligned)                 # with each document's share in the corpus' pair counts

Both sides encode space + text: A is a byte-level BPE tokenizers file, B a sentencepiece model, which adds the space itself.

The transducer reads whichever side lags.  Its state is the side that leads and the bytes that it leads by, the dangling
suffix; a transition takes a state and the next token to the next state and is computed once in a worker.  Where the
suffix is empty a group closes.  The last tokens of a group's sides end together and are its link.

Two tokens are linked only if the bytes of one end with those of the other, so there are at most as many different pairs as
both vocabularies have bytes together (some 600,000).  Their corpus-wide counts are summed from counts a document and then
fit a broadcast at any size of the corpus.

Texts that are null or empty, or that either side doesn't give back byte by byte (B writes spaces for U+2581), have no tokens:
zeros and an empty string of groups.  Repeated rows count each; null ids are carried along; an empty table gives an empty
result.  Very long texts are aligned whole, in one task.  Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.bpe import Bpe, bpe
from sextant.llm.common import materialize

#: Characters of text after which a batch is given back.
OUT = 1 << 21
#: A pair (a, b) is a * WIDTH + b.
WIDTH = 1 << 16


class Transducer:
    """Groups of two token sequences over the same bytes."""

    def __init__(self, a_tokens: list[bytes], b_tokens: list[bytes]):
        self.tokens = a_tokens, b_tokens
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # (the side that leads, the bytes that it leads by); 0: even, A is next
        self.numbers = {(1, b""): 0}
        self.lags = [0]  # the side that is read in a state
        self.moves: tuple[dict[int, int], dict[int, int]] = {}, {}  # state and next token to state
        self.told: dict[int, str] = {}  # groups of one token a side
        self.words = [str(i) for i in range(max(len(a_tokens), len(b_tokens)))]

    def move(self, state: int, side: int, token: int) -> int:
        lead, rest = self.states[state]
        new = self.tokens[side][token]
        if not rest:
            lead, rest = side, new
        elif rest.startswith(new):
            rest = rest[len(new) :]
        elif new.startswith(rest):
            lead, rest = side, new[len(rest) :]
        else:
            raise ValueError("the sides hold different bytes")
        key = (lead, rest) if rest else (1, b"")
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.lags.append(1 - lead)
        self.moves[side][state * WIDTH + token] = self.numbers[key]
        return self.numbers[key]

    def groups(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """Each group as `a1,a2|b1,b2`, and its link, the pair of its last tokens.

        The two moves of a group of one token a side are kept as one.
        """
        told, links, known, lags, words = [], [], self.told, self.lags, self.words
        to_a, to_b = (m.get for m in self.moves)
        rest_a, rest_b, one_of, tell, add = iter(a), iter(b), known.get, told.append, links.append
        for x, y in zip(rest_a, rest_b):  # even: A is next, and then leads until B has moved
            link = x * WIDTH + y
            group = one_of(link)
            if group is None:
                state = to_a(x)
                state = self.move(0, 0, x) if state is None else state
                new = to_b(state * WIDTH + y)
                state = self.move(state, 1, y) if new is None else new
                if not state:
                    group = known[link] = f"{words[x]}|{words[y]}"
                else:
                    xs, ys = [words[x]], [words[y]]
                    while state:
                        if lags[state]:
                            y = next(rest_b)
                            ys.append(words[y])
                            new = to_b(state * WIDTH + y)
                            state = self.move(state, 1, y) if new is None else new
                        else:
                            x = next(rest_a)
                            xs.append(words[x])
                            new = to_a(state * WIDTH + x)
                            state = self.move(state, 0, x) if new is None else new
                    link, group = x * WIDTH + y, f"{','.join(xs)}|{','.join(ys)}"
            tell(group)
            add(link)
        return told, links


class Aligner:
    """Both tokenizers and the transducer of a worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a: Bpe = bpe(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(len(names), len(self.a.tokens)) > WIDTH:
            raise ValueError("a vocabulary holds too many tokens")
        piece = lambda i, n: bytes([int(n[3:-1], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode()
        self.transducer = Transducer(self.a.tokens, [piece(i, n) for i, n in enumerate(names)])

    def document(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        none = 0, 0, 0, "", np.zeros(0, "i8"), np.zeros(0, "i4")
        if not text:
            return none
        a, b = self.a.plain(" " + text), self.b.encode(text)  # A's tokens are the text's bytes, however they are merged
        if b"".join(map(self.transducer.tokens[1].__getitem__, b)) != (" " + text).encode():
            return none
        told, links = self.transducer.groups(a.tolist(), b)
        pairs, counts = np.unique(np.array(links), return_counts=True)
        return len(a), len(b), len(told), ";".join(told), pairs, counts.astype("i4")


_loaded: dict = {}


def aligner(*paths: str) -> Aligner:
    if paths not in _loaded:
        _loaded[paths] = Aligner(*paths)
    return _loaded[paths]


FIELDS = "n_a long, n_b long, n_groups long, groups string, pairs array<long>, counts array<int>"


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, pairs, counts of every row of docs (doc_id, text).

    groups: `a1,a2|b1;a3|b2,b3`, the ids of each group in order.  pairs and counts: its different links and how often each
    stands in the text.
    """
    rows = docs.select("doc_id", "text")
    names = ["doc_id", *(f.split(" ")[0] for f in FIELDS.split(", "))]

    def batch(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        n_a, n_b, n, told, pairs, counts = zip(*found)
        ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (pairs, counts)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n)), pa.array(told, pa.string()), *lists], names=names)

    def run(batches):
        both = aligner(a_path, b_path)
        for b in batches:
            start, held, found = 0, 0, []
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                found.append(both.document(text))
                held += len(text or "")
                if held >= OUT or i == b.num_rows - 1:
                    yield batch(b.column(0).slice(start, len(found)), found)
                    start, held, found = i + 1, 0, []

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def best(aligned: DataFrame) -> DataFrame:
    """The rows with n_links, n_best and count_sum in place of pairs and counts.

    A pair's count is how many links of all rows hold it.  n_best: links whose count is the highest of their B id's pairs,
    ties included; count_sum: counts summed over links.  aligned is read twice, so give a written table.
    """
    spark = aligned.sparkSession
    every = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy("x.pairs").agg(F.sum("x.counts").alias("n"))
    table = every.toArrow()  # at most as many rows as both vocabularies have bytes
    keys, counts = (np.asarray(table.column(i).combine_chunks()).astype("i8") for i in (0, 1))
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    most = np.zeros(WIDTH, "i8")
    np.maximum.at(most, keys % WIDTH, counts)
    held = spark.sparkContext.broadcast((keys, counts, counts == most[keys % WIDTH]))
    kept = [c for c in aligned.columns if c not in ("pairs", "counts")]
    out = aligned.select(*kept, "pairs", "counts")

    def run(batches):
        keys, counts, top = held.value
        for b in batches:
            pairs, n = b.column(len(kept)), b.column(len(kept) + 1)
            at = keys.searchsorted(np.asarray(pairs.flatten()))
            n_each, row = np.asarray(n.flatten()).astype("i8"), np.repeat(np.arange(b.num_rows), np.asarray(pairs.value_lengths()))
            sums = np.zeros((3, b.num_rows), "i8")
            for s, x in zip(sums, (n_each, n_each * top[at], n_each * counts[at])):
                np.add.at(s, row, x)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *map(pa.array, sums)], names=[*kept, "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    return out.mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long")


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    rows = align(docs, a_path, b_path)
    told = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    kept = materialize(rows.withColumn("groups_sha256", told).drop("groups"))
    return best(kept).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
