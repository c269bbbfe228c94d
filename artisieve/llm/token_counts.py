"""Token counts by the whole-token shortcut.

A piece vocabulary in which the blank marker never follows another character cannot merge across a
blank, so a text falls into chunks (blanks, then non-blanks) that are encoded independently. Offline,
every vocabulary string is encoded alone; those that give one token are *proven* and count as one.
Other chunks are merged by the library, once for each distinct chunk that a worker meets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from artisieve.llm.common import slices

BLANK = "▁"
CHUNK = re.compile(" *[^ ]+| +")


class ChunkCounter(dict):
    """chunk (first blank dropped) -> number of tokens."""

    def __init__(self, model_path: str, bound: int = 500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bound = bound
        self.lead = len(self.model.encode("x"))
        self.splits = self._splits()
        self.proven = self._prove() if self.splits else {}
        self.update(self.proven)

    def _pieces(self) -> list[str]:
        m = self.model
        return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]

    def _splits(self) -> bool:
        """Whether blanks are kept one for one and no piece joins a blank to what stands before it."""
        m = self.model
        kept = all(m.decode(m.encode(t)) == t for t in (" a  b ", "ﬁ Ａ　x\ty\n"))
        return kept and m.encode("", out_type=str) == [] and not any(BLANK in p.lstrip(BLANK) for p in self._pieces())

    def _alone(self, chunk: str) -> int:
        """Tokens of blank + ``chunk``, encoded behind a letter so that the library's own leading blank stays out."""
        return len(self.model.encode("x " + chunk)) - self.lead

    def _prove(self) -> dict[str, int]:
        plain = [p[1:].replace(BLANK, " ") for p in self._pieces() if p.startswith(BLANK)]
        counts = self.model.encode(["x " + p for p in plain])
        return {p: 1 for p, ids in zip(plain, counts, strict=True) if len(ids) - self.lead == 1}

    def __missing__(self, chunk: str) -> int:
        n = self._alone(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.bound:
                self.clear()
                self.update(self.proven)
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text))
        if BLANK in text:
            text = text.replace(BLANK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return sum(self[c[1:]] for c in CHUNK.findall(" " + text))
        return sum(map(self.__getitem__, text.split(" ")))


_counters: dict[str, ChunkCounter] = {}


def counter(model_path: str) -> ChunkCounter:
    """One counter for each worker process."""
    if model_path not in _counters:
        _counters[model_path] = ChunkCounter(model_path)
    return _counters[model_path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``, without a shuffle.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted
    each; other columns are not read. ``model_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for whole in batches:
            for b in slices(whole):
                texts = b.column(1).to_pylist()
                n = [c.count(t) for t in texts]
                size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
