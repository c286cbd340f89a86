"""Token counts of a subword model, whole texts, huge ones by overlap resynchronisation.

A position is a *proven stable* boundary where no piece of the vocabulary holds
the two characters around it side by side: merging can never cross it, whatever
stands left or right. Counts therefore add up over such boundaries.

A text over ``LONG`` characters is encoded in overlapping chunks. Each encoding
gives the offsets at which its pieces begin; two neighbours are spliced at a
proven stable boundary inside their overlap at which both begin a piece. If an
overlap has none, it is widened (doubled) and the right chunk is encoded anew;
in the worst case the chunks become one. Memory is bounded by the chunk, not
by the text. Other texts add up the counts of their words, which are proven
stable segments, so that each distinct word is encoded once per worker.

Defined results: null and empty texts have 0 tokens and 0 bytes; copies have
equal counts; special strings inside texts are ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, utf8

#: Characters above which a text is encoded in chunks, of a chunk, and of the first overlap.
LONG, CHUNK, OVERLAP = 1 << 15, 1 << 14, 256
#: Words whose counts a worker remembers at most.
MEMO = 400_000
#: White space in the model, and the space it stands for.
MARK = "▁"
WORDS = re.compile(rf"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


class PieceCounter:
    """Counts tokens of a sentencepiece model with an identity normaliser."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, long: int = LONG):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.long = chunk, overlap, long
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.memo: dict[str, int] = {}
        probe = " a  ﬁ①\n b "
        if self.sp.decode(self.sp.encode(probe)) != probe:
            raise ValueError(f"{path}: its normaliser changes texts, so that chunks can't be counted by characters")
        #: Whether every change from another character to white space is a stable boundary.
        self.by_word = not any(x[1] == MARK and x[0] != MARK for x in self.inside)

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", MARK) not in self.inside

    def begins(self, text: str, start: int, end: int) -> list[int]:
        """Where the pieces of a chunk begin; chunks inside a text have one space more in front, at no offset."""
        pieces = self.sp.encode(text[start:end], out_type=str)
        at, out = start - 1, []
        left = 0  # bytes that pieces of a character in bytes still have to come
        for p in pieces:
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                if left == 0:
                    b = int(p[3:5], 16)
                    left = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                out.append(at)
                left -= 1
                at += left == 0
            else:
                out.append(at)
                at += len(p)
        return [max(start, x) for x in out]

    def count_long(self, text: str) -> int:
        total = cut = since = 0  # tokens before the cut; the last splice; where the left encoding starts
        left, end = self.begins(text, 0, self.chunk), self.chunk
        while end < len(text):
            overlap, at = self.overlap, None
            while at is None:
                start = max(cut, end - overlap)
                right = self.begins(text, start, end + self.chunk)
                both = set(left) & set(right)
                at = next((p for p in range(end - 1, start, -1) if p in both and self.stable(text, p)), None)
                if start == cut:
                    break
                overlap *= 2
            end += self.chunk
            if at is None:  # nothing stable since the last splice: both chunks become one, twice as long each time
                end += end - since
                left = [p for p in self.begins(text, since, end) if p >= cut]
            else:
                total += sum(p < at for p in left)
                left, cut, since = [p for p in right if p >= at], at, start
        return total + len(left)

    def count_all(self, texts: list[str]) -> list[int]:
        """Counts of many texts; unknown words are encoded together."""
        if not self.by_word:
            return [self.count_long(t) if len(t) > self.long else len(self.sp.encode(t)) for t in texts]
        split = [None if len(t) > self.long else self.words(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        if new := list({w for words in split if words for w in words if w not in memo}):
            memo.update(zip(new, map(len, self.sp.encode(new, num_threads=1))))
        memo[""] = 1  # a single space at the end of a text: one piece
        get = memo.__getitem__
        return [self.count_long(t) if words is None else sum(map(get, words)) for t, words in zip(texts, split)]

    @staticmethod
    def words(text: str) -> list[str]:
        """The stable segments, each without the one space that the model puts in front of every text."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        first, *rest = WORDS.findall(text)
        return [first, *(w[1:] for w in rest)]


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for b in batches:
            texts = utf8(b.column(1))
            n = count.count_all([t.decode() for t in texts])
            cols = [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(slim, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
