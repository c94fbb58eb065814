"""Alignment of two tokenizers over a corpus, each distinct segment once.

A text is cut before runs of white space where neither vocabulary can put a token across.
Documents are written as numbers of the segments of their block, each block with its
dictionary; the dictionaries meet by segment, each distinct one is tokenised and aligned
once, and the alignments go back to the blocks, whose documents are composed of them.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.llm.segments import _BYTE_LETTERS
from stratamem.llm.shared import arrow_rows, lean, materialise, small_batches

#: Characters of a block's documents, about; its dictionary is in one task's memory.
BLOCK_CHARS = 1 << 25
#: Dictionary rows that a task aligns, about.
SHARE = 1 << 19
#: Linked id pairs that are broadcast; more of them are joined by shuffle.
FEW_PAIRS = 2_000_000
#: Rows of an Arrow batch of short rows.
SHORT_ROWS = 8192
#: Characters of composed groups that leave a task at once.
OUT_CHARS = 1 << 23

#: What the second vocabulary writes for a space; a text that has the sign itself can't be told from one with spaces.
SIGN = "▁"
#: White space before which a text may be cut, if the vocabularies allow it.
CUTS = " \n\t"


@lru_cache(maxsize=4)
def load_a(path: str):
    """A byte-level vocabulary, special strings in texts as ordinary text, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    byte_of = {letter: n for n, letter in enumerate(_BYTE_LETTERS)}
    tokens = [tokenizer.id_to_token(n) or "" for n in range(tokenizer.get_vocab_size())]
    return tokenizer, [bytes(byte_of.get(c, 63) for c in t) for t in tokens]


@lru_cache(maxsize=4)
def load_b(path: str):
    """A piece vocabulary with byte fallback, and the bytes of each id."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [pieces.id_to_piece(n) for n in range(pieces.get_piece_size())]
    return pieces, [bytes([int(x[3:5], 16)]) if pieces.is_byte(n) else x.replace(SIGN, " ").encode() for n, x in enumerate(names)]


@lru_cache(maxsize=4)
def safe_cuts(path_a: str, path_b: str) -> str:
    """The characters of ``CUTS`` before which no token of either vocabulary goes on after something other than white space.

    The first vocabulary's pre-tokenizer ends a pre-token there, and its tokens are looked
    through all the same. The second has no pre-tokenizer: merging can't cross a place that
    no piece spans. A line feed or tab must be no piece's later character at all, as a
    segment that starts with one is encoded after a space that is then taken away.
    """
    a, b = ([x.decode(errors="replace") for x in load(path)[1]] for load, path in ((load_a, path_a), (load_b, path_b)))
    across = {c: re.compile(rf"\S{re.escape(c)}") for c in CUTS}
    later = {c: across[c] if c == " " else re.compile(rf"(?s:.){re.escape(c)}") for c in CUTS}
    return "".join(c for c in CUTS if not any(map(across[c].search, a)) and not any(map(later[c].search, b)))


def cutter(cuts: str) -> re.Pattern:
    """Segments of a text: white space and what follows it, up to white space that may be cut before."""
    return re.compile(rf"\s*\S+(?:(?![{re.escape(cuts)}])\s+\S*)*|\s+" if cuts else r"(?s:.+)")


def encode_a(path: str, segments: list[str]) -> list[list[int]]:
    return [x.ids for x in load_a(path)[0].encode_batch(segments, add_special_tokens=False)]


def encode_b(path: str, segments: list[str]) -> list[list[int]]:
    """The ids of each segment inside a text; the vocabulary puts a space before what it encodes."""
    pieces = load_b(path)[0]
    found = pieces.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
    for n, s in enumerate(segments):
        if s == " ":
            found[n] = [pieces.piece_to_id(SIGN)]
        elif s[0] != " ":
            found[n] = found[n][1:]
    return found


def align(a: list[int], b: list[int], bytes_a: list[bytes], bytes_b: list[bytes]) -> tuple[str, int, list[int]]:
    """Groups as text, how many, and each overlapping pair as ``a << 32 | b``, of ids that cover the same bytes."""
    groups, links, i, j, from_i, from_j = [], [], 0, 0, 0, 0
    end_a, end_b = len(bytes_a[a[0]]), len(bytes_b[b[0]])
    while True:
        links.append(a[i] << 32 | b[j])
        if end_a == end_b:
            groups.append(f"{','.join(map(str, a[from_i : i + 1]))}|{','.join(map(str, b[from_j : j + 1]))}")
            i, j = i + 1, j + 1
            if i == len(a):
                return ";".join(groups), len(groups), links
            from_i, from_j = i, j
            end_a, end_b = end_a + len(bytes_a[a[i]]), end_b + len(bytes_b[b[j]])
        elif end_a < end_b:
            i += 1
            end_a += len(bytes_a[a[i]])
        else:
            j += 1
            end_b += len(bytes_b[b[j]])


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers, compressed byte by byte."""
    return zlib.compress(np.ascontiguousarray(numbers.astype(kind).view("u1").reshape(-1, int(kind[-1])).T).tobytes(), 1) if len(numbers) else b""


def unpacked(body: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(body), "u1").reshape(int(kind[-1]), -1).T).view(kind).ravel() if body else np.zeros(0, kind)


def rows_of(kinds: dict[str, pa.DataType], columns: dict, n: int) -> pa.RecordBatch:
    """A batch of ``n`` rows with all columns of ``kinds``, those not given null."""
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of rows that agree in all ``columns``."""
    changes = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        changes |= np.diff(c) != 0
    edges = np.flatnonzero(changes) + 1
    return zip([0, *edges], [*edges, len(columns[0])], strict=True)


class _Numbers(dict):
    """Segment -> number, given in the order of first use."""

    def __missing__(self, segment: str) -> int:
        found = self[segment] = len(self)
        return found


def _written_in_numbers(docs: DataFrame, cuts: str, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, doc_id, body) of documents and (block, segment, local, uses) of dictionaries, in one written table."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, task, blocks = cutter(cuts).findall, TaskContext.get().partitionId(), 0
        numbers, ids, lists, chars = _Numbers(), [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            block = task << 24 | blocks
            uses = np.bincount(np.concatenate(lists) if lists else np.zeros(0, "i8"), minlength=len(numbers))
            by_use = np.argsort(-uses, kind="stable")  # frequent segments get small numbers, which take less room
            local = np.empty(len(by_use), "i8")
            local[by_use] = np.arange(len(by_use))
            names = list(numbers)
            kinds = {"block": pa.int64(), "doc_id": id_kind, "body": pa.binary(), "segment": pa.string(), "local": pa.int32(), "uses": pa.int64()}
            for k in range(0, len(names), SHORT_ROWS):
                some = by_use[k : k + SHORT_ROWS]
                yield rows_of(kinds, {"block": [block] * len(some), "segment": [names[x] for x in some], "local": range(k, k + len(some)), "uses": uses[some]}, len(some))
            for k in range(0, len(lists), 1024):
                bodies = [packed(local[x]) for x in lists[k : k + 1024]]
                yield rows_of(kinds, {"block": [block] * len(bodies), "doc_id": pa.concat_arrays(ids).slice(k, len(bodies)), "body": bodies}, len(bodies))

        for batch in batches:
            id_kind = batch.column("doc_id").type
            start = 0
            for n, text in enumerate(batch.column("text").to_pylist()):
                if text and SIGN not in text:
                    lists.append(np.fromiter(map(numbers.__getitem__, find(f" {text}")), "i8"))
                    chars += len(text)
                else:
                    lists.append(np.zeros(0, "i8"))
                if chars > BLOCK_CHARS:
                    ids.append(batch.column("doc_id").slice(start, n + 1 - start))
                    yield from close()
                    numbers, ids, lists, chars, start, blocks = _Numbers(), [], [], 0, n + 1, blocks + 1
            ids.append(batch.column("doc_id").slice(start))
        if lists:
            yield from close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"block long, doc_id {id_type}, body binary, segment string, local int, uses long"
    with arrow_rows(docs.sparkSession, 1024):
        return materialise(rows.mapInArrow(lean(run), schema), "align-blocks")


def _aligned(dictionary: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (task, number, uses, n_a, n_b, n_groups, groups, pairs) of distinct segments, and (task, block, locals, numbers)
    of their places: which of a block's segments are which of the task's. Written.

    A task has its segments in order, so the rows of a segment follow each other, and numbers them.
    """
    kinds = {"task": pa.int64(), "number": pa.int32(), "uses": pa.int64(), "n_a": pa.int32(), "n_b": pa.int32(), "n_groups": pa.int32(), "groups": pa.string(), "pairs": pa.list_(pa.int64()), "block": pa.int64(), "locals": pa.binary(), "numbers": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, at, uses_so_far = TaskContext.get().partitionId(), -1, None, 0
        bytes_a, bytes_b = load_a(path_a)[1], load_b(path_b)[1]
        places: list[tuple] = []

        def done(segments: list[str], numbers: list[int], uses: list[int]) -> pa.RecordBatch:
            ids_a, ids_b, found = encode_a(path_a, segments), encode_b(path_b, segments), []
            for s, a, b in zip(segments, ids_a, ids_b, strict=True):
                text = s.encode()
                if b"".join([bytes_a[x] for x in a]) != text or b"".join([bytes_b[x] for x in b]) != text:
                    raise ValueError(f"the tokens of {s!r} do not cover it")
                found.append(align(a, b, bytes_a, bytes_b))
            columns = {"task": [task] * len(segments), "number": numbers, "uses": uses, "n_a": list(map(len, ids_a)), "n_b": list(map(len, ids_b))}
            return rows_of(kinds, columns | {"n_groups": [x[1] for x in found], "groups": [x[0] for x in found], "pairs": [x[2] for x in found]}, len(segments))

        for batch in batches:
            numbers, closed = [], ([], [], [])
            for s, n in zip(batch.column("segment").to_pylist(), batch.column("uses").to_pylist(), strict=True):
                if s != at:
                    if at is not None:
                        for x, y in zip(closed, (at, number, uses_so_far), strict=True):
                            x.append(y)
                    at, uses_so_far, number = s, 0, number + 1
                uses_so_far += n
                numbers.append(number)
            places.append((batch.column("block").to_numpy(), batch.column("local").to_numpy(), np.array(numbers, "i4")))
            if closed[0]:
                yield done(*closed)
        if at is None:
            return
        yield done([at], [number], [uses_so_far])
        blocks, local, numbers = map(np.concatenate, zip(*places, strict=True))
        order = np.argsort(blocks, kind="stable")
        blocks, local, numbers = blocks[order], local[order], numbers[order]
        found = [(blocks[i], packed(local[i:j]), packed(numbers[i:j])) for i, j in runs(blocks)]
        for k in range(0, len(found), 1024):
            some = found[k : k + 1024]
            yield rows_of(kinds, {"task": [task] * len(some), **{c: [x[n] for x in some] for n, c in enumerate(("block", "locals", "numbers"))}}, len(some))

    tasks = max(1, -(-dictionary.count() // SHARE))
    dealt = dictionary.select("segment", "block", "local", "uses").repartition(tasks, "segment").sortWithinPartitions("segment")
    schema = "task long, number int, uses long, n_a int, n_b int, n_groups int, groups string, pairs array<long>, block long, locals binary, numbers binary"
    with arrow_rows(dictionary.sparkSession, SHORT_ROWS):
        return materialise(dealt.mapInArrow(lean(run), schema), "align-segments")


#: What is counted for each segment, and added up for each document.
NUMBERS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]


def _joined_back(segments: DataFrame, scores: DataFrame, places: DataFrame) -> DataFrame:
    """(block, locals, counts, names): the alignments of a block's segments, in as many rows as tasks had some of them.

    The segments of a task, their ``scores`` (task, number, n_best, count_sum) and their
    places meet in one task again, segments and scores in the order of their numbers.
    """
    columns = {"task": "long", "kind": "int", "number": "int", "n_a": "int", "n_b": "int", "n_groups": "int", "groups": "string", "n_best": "long", "count_sum": "long", "block": "long", "locals": "binary", "numbers": "binary"}

    def all_columns(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*(F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, scored, names, ready = None, [], [], [], None
        for batch in batches:
            tasks, kinds = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
            for start, end in runs(tasks, kinds):
                part = batch.slice(start, end - start)
                if tasks[start] != at:
                    at, counts, scored, names, ready = tasks[start], [], [], [], None
                if kinds[start] == 0:
                    counts.append(np.stack([part.column(c).to_numpy() for c in NUMBERS[:3]], axis=1))
                    names += part.column("groups").to_pylist()
                elif kinds[start] == 1:
                    scored.append(np.stack([part.column(c).to_numpy() for c in NUMBERS[3:]], axis=1))
                else:
                    if ready is None:
                        ready = np.concatenate([np.concatenate(counts), np.concatenate(scored)], axis=1, dtype="i8"), np.array(names, object)
                        counts, scored, names = [], [], []
                    numbers = [unpacked(x) for x in part.column("numbers").to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("block"),
                            part.column("locals"),
                            pa.array([packed(ready[0][x].T.ravel(), "<i8") for x in numbers], pa.binary()),
                            pa.array([zlib.compress("\n".join(ready[1][x].tolist()).encode(), 1) for x in numbers], pa.binary()),
                        ],
                        names=["block", "locals", "counts", "names"],
                    )

    parts = all_columns(segments, 0).unionByName(all_columns(scores, 1)).unionByName(all_columns(places, 2))
    return parts.repartition("task").sortWithinPartitions("task", "kind", "number").mapInArrow(lean(run), "block long, locals binary, counts binary, names binary")


def pair_counts(segments: DataFrame) -> DataFrame:
    """(pair, count, best) of linked ids (``a << 32 | b``) in the corpus: ``best`` if no other pair of its b counts more. Written."""
    counts = materialise(segments.select(F.explode("pairs").alias("pair"), "uses").groupBy("pair").agg(F.sum("uses").alias("count")), "align-pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("_b")).agg(F.max("count").alias("_most"))  # a row for each id of the vocabulary
    return counts.join(most, b == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def _composed(words: DataFrame, texts: DataFrame, id_type: str) -> DataFrame:
    """Documents of their segments' alignments: a task holds one block's dictionary and passes its documents along it."""
    columns = {"block": "long", "kind": "int", "locals": "binary", "counts": "binary", "names": "binary", "doc_id": id_type, "body": "binary"}

    def all_columns(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*(F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, ready = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            for start, end in runs(blocks, kinds):
                part = batch.slice(start, end - start)
                if blocks[start] != at:
                    at, pieces, ready = blocks[start], [], None
                if kinds[start] == 0:
                    for locals_, counts, names in zip(*(part.column(c).to_pylist() for c in ("locals", "counts", "names")), strict=True):
                        pieces.append((unpacked(locals_), unpacked(counts, "<i8").reshape(len(NUMBERS), -1).T, zlib.decompress(names).decode().split("\n")))
                    continue
                if ready is None:
                    size = sum(len(x[0]) for x in pieces)
                    ready = np.zeros((size, len(NUMBERS)), "i8"), np.empty(size, object)
                    for at_local, counts, names in pieces:
                        ready[0][at_local], ready[1][at_local] = counts, names
                    pieces = []
                yield from compose(part, *ready)

    def compose(part: pa.RecordBatch, counts: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums, groups, first, chars = [], [], 0, 0
        bodies = part.column("body").to_pylist()
        for n, body in enumerate(bodies):
            ids = unpacked(body)
            sums.append(counts[ids].sum(axis=0))
            groups.append(";".join(names[ids].tolist()))
            chars += len(groups[-1])
            if chars > OUT_CHARS or n + 1 == len(bodies):
                table = np.stack(sums)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(first, n + 1 - first), *(pa.array(table[:, k]) for k in range(len(NUMBERS))), pa.array(groups, pa.string())], names=["doc_id", *NUMBERS, "groups"])
                sums, groups, first, chars = [], [], n + 1, 0

    both = all_columns(words, 0).unionByName(all_columns(texts, 1)).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(lean(run), f"doc_id {id_type}, {', '.join(f'{c} long' for c in NUMBERS)}, groups string")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    A space and the text are encoded by the byte-level vocabulary at ``path_a`` and the piece
    vocabulary at ``path_b``, without special tokens. ``groups`` lists, between places where
    tokens of both end, the ids of both: ``a1,a2|b1;a3|b2,b3``. Tokens whose bytes overlap are
    linked; ``n_best`` counts links whose pair of ids is, in the corpus, the most frequent of
    its b (ties included), and ``count_sum`` adds up how often each link's pair is linked.

    Edge cases: texts that are null, empty or hold U+2581, which ``path_b`` can't tell from
    a space, have no tokens: zeros and empty groups; repeated rows are rows of their own;
    null ids pass through; long texts are taken whole; an empty table gives an empty result;
    other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    written = _written_in_numbers(docs, safe_cuts(path_a, path_b), id_col, text_col)
    aligned = _aligned(written.where("segment is not null"), path_a, path_b)
    segments, places = aligned.where("groups is not null"), aligned.where("block is not null").select("task", "block", "locals", "numbers")
    pairs = materialise(pair_counts(segments), "align-best")
    if pairs.count() <= FEW_PAIRS:
        pairs = F.broadcast(pairs)
    links = segments.select("task", "number", F.explode("pairs").alias("_pair")).join(pairs, F.col("_pair") == F.col("pair"))
    scores = links.groupBy("task", "number").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    words = _joined_back(segments.select("task", "number", "n_a", "n_b", "n_groups", "groups"), scores, places)
    found = _composed(words, written.where("segment is null").select("block", "doc_id", "body"), id_type)
    # tokens of a group overlap in one pair less than there are
    return found.withColumn("n_links", F.col("n_a") + F.col("n_b") - F.col("n_groups")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def digest(groups: Column) -> Column:
    """The SHA-256 of groups in hex; empty for none."""
    return F.when(groups == "", "").otherwise(F.sha2(groups, 256))
