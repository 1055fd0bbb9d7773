"""Byte-level BPE, encoded by tree concatenation and decoded again.

    encode(docs, path)                      # doc_id, ids
    encode(docs, path, decoded=True)        # doc_id, ids, decoded
    decode(rows, path)                      # doc_id, decoded of rows (doc_id, ids)

A text of over LEAF characters is halved, wherever its middle falls, until its parts are short; parts are encoded each for
itself and joined pair by pair.  At a join, windows of growing size around the cut are encoded anew until both sides agree:

- A window that begins and ends where the split pattern always splits, whatever stands around (after a letter before another
  kind of character, and the like), and where both sides have a token's end, has the ids of the whole there.
- Inside a long run of one kind of characters, which the pattern never splits, windows of whole tokens are merged.  A sequence
  of tokens is the encoding of its bytes if each two neighbours are the encoding of theirs, so a window whose first and last
  ids are those of the sides gives the whole.
- Where neither is found the window grows to the ends of both sides.

Texts of over SPREAD characters are cut into pieces that are dealt to other tasks, each a tree of its own; the pieces of
a text are joined where it is put together again.  Strings of special tokens inside a text have their special ids, as the
tokenizers library gives them; no part crosses one.

Null and empty texts have no ids and decode to an empty text.  Repeated rows give a row each (long ones are encoded once);
null ids are carried along.  An empty table gives an empty result.  Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import row_id

#: Characters: of a part that isn't halved, of a piece for another task, of texts that are dealt in pieces.
LEAF, PIECE, SPREAD = 1 << 12, 1 << 15, 1 << 16
#: Characters on one side of a cut that are looked through for a place where the pattern always splits.
NEAR = 1 << 10
#: Bytes of text in an Arrow batch that is given back.
OUT = 1 << 22

_KINDS = r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"
#: A contraction joins an apostrophe to letters and a space joins what follows it; nothing else joins two kinds.
_SPLITS = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])")
_RUNS = [regex.compile(k + "+") for k in _KINDS]


def _settled(*chars: str) -> bool:
    """Whether the characters' kinds are the same in every Unicode version since 3.2."""
    return all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in chars)


class Bpe:
    """A byte-level BPE tokenizers file whose ids follow its merges."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow at 256
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        vocab = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranks = [spec["model"]["vocab"]["".join(m)] for m in pairs]
        if ranks != sorted(ranks) or spec.get("normalizer") or spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError(f"{path} isn't a plain byte-level BPE in the order of its merges")
        self.ranks = vocab
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for t, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.tokens[i] = t
        self._parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        base = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.leaf = lambda text: np.array(base.encode_ordinary(text), "i4")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    def merge(self, data: bytes) -> np.ndarray:
        """The ids of bytes without a split: the pair of least rank merges, the first one of equal pairs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.tokens):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return np.array([self.ranks[p] for p in parts], "i4")

    def parts(self, text: str) -> list[str]:
        """The text divided at the strings of special tokens, which are parts themselves."""
        return [p for p in self._parts.split(text) if p] if self._parts and any(s in text for s in self.special) else [text]

    def encode(self, text: str) -> np.ndarray:
        found = [np.array([self.special[p]], "i4") if p in self.special else self.tree(p, 0, len(p)) for p in self.parts(text)]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, "i4"), *found])

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text in which strings of special tokens are ordinary text."""
        return self.tree(text, 0, len(text))

    def tree(self, text: str, low: int, high: int, size: int | None = None) -> np.ndarray:
        """The ids of text[low:high]."""
        if high - low <= (size or LEAF):
            return self.leaf(text[low:high])
        cut = (low + high) // 2
        return self.join(text, low, cut, high, self.tree(text, low, cut, size), self.tree(text, cut, high, size))

    def join(self, text: str, low: int, cut: int, high: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of text[low:high] from those of text[low:cut] and text[cut:high]."""
        near = 16
        while True:
            near = min(2 * near, max(cut - low, high - cut))
            start, end = self._split(text, low, cut, near, -1), self._split(text, high, cut, near, 1)
            if start is not None and end is not None:
                if start == end:
                    return np.concatenate([a, b])
                i, j = self._ends(a[::-1], len(text[start:cut].encode())), self._ends(b, len(text[cut:end].encode()))
                if i is not None and j is not None:
                    return np.concatenate([a[: len(a) - i], self.leaf(text[start:end]), b[j:]])
            if near >= NEAR and (run := self._inside(text, low, cut, high, a, b)) is not None:
                return run
            if near == max(cut - low, high - cut):
                return self.leaf(text[low:high])
            if near >= NEAR:
                near = max(cut - low, high - cut)

    @staticmethod
    def _split(text: str, limit: int, cut: int, near: int, way: int) -> int | None:
        """The place nearest the cut, at most `near` away, where the pattern always splits; limit is one."""
        if way < 0:
            start = max(limit, cut - near)
            for m in regex.finditer(r"(?r)" + _SPLITS.pattern, text, pos=start, endpos=min(len(text), cut + 1)):
                if start < m.start() <= cut and _settled(text[m.start() - 1], text[m.start()]):
                    return m.start()
            return limit if start == limit else None
        stop = min(limit, cut + near)
        for m in _SPLITS.finditer(text, max(0, cut - 1), min(len(text), stop + 1)):
            if cut <= m.start() < min(stop + 1, limit) and _settled(text[m.start() - 1], text[m.start()]):
                return m.start()
        return limit if stop == limit else None

    def _ends(self, ids: np.ndarray, n: int) -> int | None:
        """How many of the first ids have n bytes together; None if a token crosses that place."""
        i = 0
        while n > 0 and i < len(ids):
            n -= len(self.tokens[ids[i]])
            i += 1
        return i if n == 0 else None

    def _inside(self, text: str, low: int, cut: int, high: int, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """The join inside a run of one kind of characters, by growing windows of tokens; None where the run ends too soon."""
        n = 4
        while n < min(len(a), len(b)):
            left, right = self.bytes_of(a[-n - 1 :]), self.bytes_of(b[: n + 1])
            start, end = cut - len(left.decode("utf-8", "ignore")) - 4, cut + len(right.decode("utf-8", "ignore")) + 4
            if start < low or end > high or not any(r.fullmatch(text, start, end) for r in _RUNS) or not _settled(*set(text[start:end])):
                return None
            window = self.merge(self.bytes_of(np.concatenate([a[-n:], b[:n]])))
            if window[0] == a[-n] and window[-1] == b[n - 1]:
                return np.concatenate([a[:-n], window, b[n:]])
            n *= 2
        return None


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The file's tokenizer, once for each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _give(model: Bpe, ids: list[np.ndarray], decoded: bool) -> list[pa.Array]:
    ends = np.cumsum([0, *map(len, ids)])
    out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "i4"), *ids]), pa.int32()))]
    return [*out, pa.array([model.decode(x) for x in ids], pa.string())] if decoded else out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of rows with some OUT characters together."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= OUT:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (and decoded, what the ids decode to) of every row of docs (doc_id, text)."""
    names = ["doc_id", "ids", *["decoded"] * decoded]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    carried = ["key", "doc_id", "copies", "no", "joined", "text"]
    given = f"ids array<int>{', decoded string' * decoded}"

    def whole(batches):
        model = bpe(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *_give(model, [model.encode(t) for t in texts[i:j]], decoded)], names=names)

    def cut(batches):
        model = bpe(path)
        for b in batches:
            for row, text in enumerate(b.column(3).to_pylist()):
                at = []
                for p in model.parts(text):
                    at += [(p[i : i + PIECE], i > 0) for i in range(0, len(p), PIECE)]
                held = [c.take(pa.array([row] * len(at), pa.int32())) for c in b.columns[:3]]
                cols = [pa.array(range(len(at)), pa.int32()), pa.array([x[1] for x in at], pa.bool_()), pa.array([x[0] for x in at], pa.string())]
                yield pa.RecordBatch.from_arrays([*held, *cols], names=carried)

    def piece(batches):
        model = bpe(path)
        for b in batches:
            texts = b.column(5).to_pylist()
            for i, j in _slices(texts):
                ids = [model.encode(t) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), *_give(model, ids, False)], names=[*carried, "ids"])

    def together(table: pa.Table) -> pa.Table:
        model, table = bpe(path), table.sort_by("no")
        joined, texts = table.column("joined").to_pylist(), table.column("text").to_pylist()
        ids = [np.asarray(x.values) for x in table.column("ids")]

        def tree(text: str, ends: list[int], i: int, j: int) -> np.ndarray:
            if j - i == 1:
                return ids[i]
            mid = (i + j) // 2
            return model.join(text, ends[i], ends[mid], ends[j], tree(text, ends, i, mid), tree(text, ends, mid, j))

        starts = [i for i, x in enumerate(joined) if not x]
        ends = np.cumsum([0, *map(len, texts)]).tolist()
        whole = "".join(texts)
        parts = [tree(whole[: ends[j]] if i == 0 else whole[ends[i] : ends[j]], [e - ends[i] for e in ends], i, j) for i, j in zip(starts, [*starts[1:], len(texts)])]
        held = [table.column(c).combine_chunks()[:1] for c in ("doc_id", "copies")]
        return pa.Table.from_arrays([*held, *_give(model, [np.concatenate(parts)], decoded)], names=["doc_id", "copies", *names[1:]])

    short = rows.where(F.length("text") <= SPREAD).mapInArrow(whole, f"doc_id {kind}, {given}")
    # Equal long rows are one, so that copies of a text don't meet in a task.
    long = rows.where(F.length("text") > SPREAD).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("key", row_id("doc_id", "text"))
    pieces = f"key binary, doc_id {kind}, copies long, no int, joined boolean, text string"
    dealt = long.select("key", "doc_id", "copies", "text").mapInArrow(cut, pieces).repartition("key", "no")
    put = dealt.mapInArrow(piece, f"{pieces}, ids array<int>").groupBy("key").applyInArrow(together, f"doc_id {kind}, copies long, {given}")
    return short.unionByName(put.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*names))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded of rows (doc_id, ids); null ids decode to an empty text, ids that the file doesn't know to nothing."""

    def run(batches):
        model = bpe(path)
        for b in batches:
            texts = [model.decode(np.array([i for i in x or [] if i is not None and 0 <= i < len(model.tokens)], "i8")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    out = encode(docs, path, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
