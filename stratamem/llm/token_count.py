"""Token counts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.segments import OTHER_SPACE, WITH_SPACE, Memo, load
from stratamem.llm.shared import lean, small_batches

#: Characters of a chunk; longer documents are encoded in chunks.
CHUNK = 32_768
OVERLAP = 256
#: Characters before a chunk's end in which its cuts may still depend on what follows:
#: the special string of the vocabularies has 13, a contraction 3.
MARGIN = 16


class Cuts:
    """Where a chunk's pre-tokens start, as positions in the whole text, and the tokens before each."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        encoding = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.tokens, self.at, self.before = len(encoding.ids), [], []
        last = None
        for n, (word, (first, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
            if word is None or word != last:
                self.at.append(start + first)
                self.before.append(n)
            last = word


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, encoded in overlapping chunks.

    A chunk that starts at a true cut has the true cuts up to ``MARGIN`` before its end, as
    cutting runs from left to right and looks ahead by less. The next chunk starts inside
    it, anywhere; the first cut that both share is where they are spliced: from a cut on,
    tokens depend only on the text that follows, so both agree with the whole text there.
    Without a shared cut the overlap is doubled, up to the whole chunk, and then the chunk.
    """
    start, done = 0, 0  # the chunk's tokens from `start` on are not counted yet
    begin, size = 0, chunk
    cuts = Cuts(tokenizer, text, 0, min(size, len(text)))
    while True:
        end = min(begin + size, len(text))
        skipped = cuts.before[bisect_left(cuts.at, start)] if cuts.at else 0
        if end == len(text):
            return done + cuts.tokens - skipped
        shared, width = None, overlap
        while shared is None and width < end - start:
            following = end - width
            ahead = Cuts(tokenizer, text, following, min(following + chunk, len(text)))
            common = set(ahead.at).intersection(x for x in cuts.at if following < x <= end - MARGIN)
            shared = min(common, default=None)
            width *= 2
        if shared is None:
            size *= 2
            cuts = Cuts(tokenizer, text, begin, min(begin + size, len(text)))
            continue
        done += cuts.before[bisect_left(cuts.at, shared)] - skipped
        start, begin, size, cuts = shared, following, chunk, ahead


@lru_cache(maxsize=4)
def _memo(path: str) -> Memo:
    return Memo(load(path), len, lower=False)


def count_batch(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text."""
    tokens_of, tokenizer = _memo(path).__getitem__, load(path)
    return [count_spliced(tokenizer, t) if len(t) > CHUNK or OTHER_SPACE.search(t) else sum(map(tokens_of, WITH_SPACE.findall(t))) for t in texts]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens``.

    Counts are the library's for the whole text, without added special tokens; special
    strings inside a text count as the library's default has them. Documents above
    ``CHUNK`` characters go through ``count_spliced``, so memory follows the chunk.

    ``tokenizer_path`` names a byte-level BPE file that every executor can read.

    Edge cases: null counts as empty (0 tokens); repeated rows are counted each; null ids
    pass through; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: list[int] = []
            texts = batch["text"].tolist()
            for i in range(0, len(texts), 256):
                counts += count_batch(tokenizer_path, texts[i : i + 256])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": pd.Series(counts, dtype="int64")})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    return rows.mapInPandas(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long")
