"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded at once. A longer one is cut into chunks that overlap; all are
encoded with offsets, and neighbours are spliced at a boundary that both have between two pre-tokens and that
is proven stable: the left chunk goes on for ``MARGIN`` characters behind it, more than the pre-tokeniser's look-ahead
and than any added token, so its end cannot have moved the boundary, and from a common boundary on the
right chunk reads what a scan of the whole text would read. Where no such boundary is found, the left chunk is
encoded again with twice the overlap, up to the end of the text, at which no splice is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import small_arrow_batches

#: Characters of the left chunk that must follow a splice.
MARGIN = 64


def boundaries(encoding) -> dict[int, int]:
    """Start of every pre-token (and added token) in characters -> number of tokens before it."""
    found, last = {}, None
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last:
            found.setdefault(start, i)
            last = word
    return found


def count_long(tokenizer, text: str, chunk: int, overlap: int, margin: int = MARGIN) -> int:
    """Tokens of ``text`` from overlapping chunks; the same number as encoding it at once.

    Each chunk is trusted from ``origin``, a true boundary of the whole text, up to its splice with the next.
    """
    total, origin, start, reach, right = 0, 0, 0, chunk + overlap, None
    encoded = tokenizer.encode(text[:reach], add_special_tokens=False)
    while True:
        left = boundaries(encoded)
        if start + reach >= len(text):
            return total + len(encoded.ids) - left.get(origin - start, 0)
        following = start + chunk
        right = right or tokenizer.encode(text[following : following + chunk + overlap], add_special_tokens=False)
        ahead = boundaries(right)
        limit = min(start + reach, len(text)) - margin
        splice = next((following + p for p in sorted(ahead) if origin <= following + p <= limit and following + p - start in left), None)
        if splice is None:
            reach = min(reach + max(reach - chunk, 1), len(text) - start)  # twice the overlap
            encoded = tokenizer.encode(text[start : start + reach], add_special_tokens=False)
            continue
        total += left[splice - start] - left.get(origin - start, 0)
        origin, start, encoded, right, reach = splice, following, right, None, chunk + overlap


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, limit: int = 512, chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text of ``docs``.

    vocabulary: path of a tokenizers JSON file, readable where Python runs. Null counts as empty (0 tokens). One
    row for each row, repeated ones too; other columns are not read.
    """
    small_arrow_batches(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = {i: count_long(tokenizer, t, chunk, overlap) for i, t in enumerate(texts) if len(t) > chunk}
            counts.update(zip(short, map(len, tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False))))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [counts[i] for i in range(len(texts))]})

    return docs.select("doc_id", "text").mapInPandas(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
