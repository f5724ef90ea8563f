"""Token counts of texts and of their sections by offset-mapped attribution.

Every whole text is encoded once. The lengths of the tokens' byte strings give each token's span; the
spans are interval-joined to the sections by binary search in the sections' starts. A section is a line
with the \\n that ends it. A token that crosses a boundary goes to the section that holds most of its
bytes, the earlier one in a tie, so section counts add up to the text's count.

The vocabulary is a file of base64 tokens and ranks, a path or URI that Spark reads. It is sent to the tasks
and may have at most ``MAX_VOCABULARY`` bytes. Special tokens' strings are ordinary text.

Defined cases: a null or empty text has no tokens and no sections; repeated rows each give a row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MAX_VOCABULARY = 16 << 20
#: Fixed value: how a text is cut before tokens are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """The encoding, and the length in bytes of each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        size[k] = len(token)
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens per section, and the tokens that cross a boundary; ``sections`` are the starts in order."""
    first = np.searchsorted(sections, start, "right") - 1
    last = np.searchsorted(sections, end - 1, "right") - 1
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    for t in crossing.tolist():
        a, b = first[t], last[t]
        edges = np.concatenate([[start[t]], sections[a + 1 : b + 1], [end[t]]])
        owner[t] = a + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(sections)), len(crossing)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Per document: id, n_tokens, n_sections, n_crossing, section_tokens (an array in the text's order)."""
    spark = docs.sparkSession
    file = spark.read.format("binaryFile").load(vocabulary)
    size_ = file.agg(F.max("length")).first()[0]
    if size_ > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary has {size_} bytes; {MAX_VOCABULARY} are allowed")
    held = spark.sparkContext.broadcast(bytes(file.select("content").first()[0]))

    def run(batches):
        coder, size = encoder(held.value, pattern)
        for part, data, off in B.chunks(batches):
            rows = ([], [], [], [])
            text, line = data.tobytes(), np.flatnonzero(data == 10) + 1
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                if a == b:
                    counts, crossing, n = np.zeros(0, np.int64), 0, 0
                else:
                    tokens = coder.encode_to_numpy(text[a:b].decode(), disallowed_special=())
                    end = np.cumsum(size[tokens])
                    lines = line[np.searchsorted(line, a, "right") : np.searchsorted(line, b)] - a
                    counts, crossing = attribute(end - size[tokens], end, np.concatenate([[0], lines]))
                    n = len(tokens)
                for out, x in zip(rows, (n, len(counts), crossing, counts.tolist()), strict=True):
                    out.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=["id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>").withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
