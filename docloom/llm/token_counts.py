"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.vocab import MEMO_CHARS, MEMO_ENTRIES, by_bytes, safe_pieces
from docloom.runtime import ship

BATCH_BYTES = 500_000

_ENCODERS: dict = {}


class _Counter:
    """Counts tokens of pieces, in batches of about equal bytes; short pieces are remembered."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cut = lambda text: [text]  # its words depend on neighbours: whole texts
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.cut = safe_pieces
            self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.memo: dict[str, int] = {}

    def _learn(self, pieces: list[str], into: dict[str, int]) -> None:
        pieces.sort(key=len)
        batch, size = [], 0
        for i, piece in enumerate(pieces):
            batch.append(piece)
            size += len(piece)
            if size >= BATCH_BYTES or i == len(pieces) - 1:
                into.update(zip(batch, self.lengths(batch), strict=True))
                batch, size = [], 0

    def count(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        memo, cut = self.memo, []
        short, long = set(), set()
        for text in texts:
            head, *rest = self.cut(text)
            keys = [head, *(f" {x}" for x in rest)]
            cut.append(keys)
            for key in set(keys).difference(memo):
                (short if len(key) <= MEMO_CHARS else long).add(key)
        self._learn(list(short), memo)
        once: dict[str, int] = {}
        self._learn(list(long), once)
        if once:
            return [sum(memo[k] if k in memo else once[k] for k in keys) for keys in cut]
        return [sum(map(memo.__getitem__, keys)) for keys in cut]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    ``vocabulary``: a tokenizers ``.json`` or a sentencepiece ``.model`` file.
    No begin, end or added special tokens, no truncation and no padding; special
    strings within a text are handled as the library does by default.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows and null keys
    give a row each; other columns are ignored. No shuffle: each scan partition
    is encoded where it is read, with slices of a few MB of text in memory.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _ENCODERS.get(vocabulary)
        if counter is None:
            counter = _ENCODERS[vocabulary] = _Counter(vocabulary)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key"), sizes, pa.array(counter.count(texts), pa.int64())], ["key", "n_bytes", "n_tokens"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(encode, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract query: tokens of every document under the byte-level BPE vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
