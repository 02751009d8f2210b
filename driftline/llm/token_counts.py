"""Token counts: batch encoding in Arrow functions that return lengths only.

White space never lies inside a token of the tokenizers meant here, and the
text on either side of it is encoded alike whatever stands beyond it, so texts
are split there. Pieces go to the library in batches of about equal bytes; a
piece's length is kept for the task, as pieces repeat. What cannot be split is
encoded as it is. For a tokenizer for which white space is no safe boundary
pass ``split=False``: then whole texts are batched.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); an empty table
gives an empty result; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import slices, small_batches

#: Bytes of text in one call of the library.
BATCH_BYTES = 1 << 20
#: Lengths kept by a task; beyond that it starts anew.
KEPT = 1 << 18

_loaded: dict = {}


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, one for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def load_pieces(path: str):
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def lengths(texts: list[str], path: str) -> list[int]:
    """Numbers of tokens, without special tokens added."""
    if path.endswith(".model"):
        return [len(x) for x in load_pieces(path).encode(texts, num_threads=1)]
    return [len(x) for x in load_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def batches(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of ``most`` bytes together at most; a longer one stands alone."""
    batch, held = [], 0
    for x in texts:
        size = len(x) if x.isascii() else len(x.encode())
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(x)
        held += size
    if batch:
        yield batch


class Lengths(dict):
    """Piece -> number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def learn(self, pieces: set[str]) -> None:
        if len(self) + len(pieces) > KEPT:
            self.clear()
        new = [x for x in pieces if x not in self]
        for batch in batches(new):
            self.update(zip(batch, lengths(batch, self.path), strict=True))


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, split: bool | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``, whole texts."""
    split = path.endswith(".json") if split is None else split

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lengths(path)
        get = known.__getitem__
        for part in slices(parts):
            texts = [x or "" for x in part.column(1).to_pylist()]
            if split:
                n_tokens = []
                for group in batches(texts):
                    # bytes.split() splits at the space and U+0009 to U+000D only
                    pieces = [x.encode().split() for x in group]
                    known.learn({p.decode() for p in {y for x in pieces for y in x}})
                    n_tokens += [sum(map(get, (y.decode() for y in x))) for x in pieces]
            else:
                n_tokens = [n for group in batches(texts) for n in lengths(group, path)]
            n_bytes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    out = small_batches(source).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
