"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than a chunk is encoded in chunks that overlap.  Two neighbours
are spliced in their overlap where both encodings have a boundary that is
proven: the two characters around it stand next to each other in no piece of
the vocabulary, so no merge crosses it, whatever the text around.  Tokens up to
there count from the first chunk, tokens from there on from the second.  If the
overlap holds no such place it is widened, in the end to the rest of the text.

Defined results: a null text is the empty text and has no tokens; equal rows
get equal counts; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 16_384, 512
LIMIT = 4096


class PieceCounter:
    """Token counts of a sentencepiece model."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        special = (self.lib.is_control, self.lib.is_unknown, self.lib.is_byte, self.lib.is_unused)
        pieces = [
            self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()) if not any(f(i) for f in special)
        ]
        self._inside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}

    def forced(self, left: str, right: str) -> bool:
        """No piece holds ``left`` and ``right`` next to each other."""
        return (left + right).replace(" ", "▁") not in self._inside

    def starts(self, text: str) -> list[int]:
        """Where the tokens of ``text`` start, in characters."""
        return [o[0] for o in self.lib.encode(text, return_type="offset_mapping")["offsets"]]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk:
            return len(self.lib.encode(text))
        total, begin, first = 0, 0, None  # tokens before ``first`` are counted already
        end = chunk
        while True:
            here = self.starts(text[begin:end])
            while end < len(text):
                found = self._splice(text, begin, end, here, min(overlap, (end - begin) // 2), first, chunk)
                if found:
                    break
                end = min(len(text), end + 2 * (end - begin))  # no proven place in reach: a longer chunk
                here = self.starts(text[begin:end])
            low = 0 if first is None else first - begin
            if end >= len(text):
                return total + sum(s >= low for s in here)
            place, begin_next = found
            total += sum(low <= s < place - begin for s in here)
            first, begin = place, begin_next
            end = min(len(text), begin + chunk)

    def _splice(
        self, text: str, begin: int, end: int, here: list[int], overlap: int, first: int | None, chunk: int
    ) -> tuple[int, int] | None:
        """A proven place that this chunk and the next share, and where the next begins."""
        mine = {begin + s for s in here}
        while True:
            start = max(end - overlap, begin if first is None else first)
            other = self.starts(text[start : min(len(text), end + overlap)])
            both = [
                p for p in (start + s for s in other) if start < p < end and p in mine and self.forced(text[p - 1], text[p])
            ]
            if both:
                return both[len(both) // 2], start
            if start <= (begin if first is None else first):
                return None
            overlap *= 2


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model: str) -> PieceCounter:
    """The counter of a model file, made once in each worker."""
    if model not in _COUNTERS:
        _COUNTERS[model] = PieceCounter(model)
    return _COUNTERS[model]


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            counts = [count.count(t.as_py() or "") for t in batch.column("text_")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    chosen = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(f"`{text}`").alias("text_"),
    )
    kind = chosen.schema["doc_id"].dataType.simpleString()
    counted = chosen.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
