"""Packing by power-of-two decomposition: every document is cut into pieces whose lengths are powers of two, and
pieces of equal length form a bucket. Each piece is a sequence of its own, so no sequence crosses documents and
none needs padding; a trainer draws batches from one bucket at a time.

One narrow pass: tokenise, cut, number. Nothing is shuffled, and no task holds more than a few MB of text.
The ids of a text are those of its white-space-separated words in turn, and the ids of a plain word those of its
runs of letters, digits and signs, which the tokeniser treats apart; so each distinct run is tokenised once a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import sliced, small_batches

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"
)
#: Runs whose ids a task remembers before it starts anew.
RUNS_KEPT = 350_000
#: Bytes of text that a task works on at a time; a longer text is worked on alone.
SLICE = 3 << 20
#: The pre-tokeniser's runs in lower-case words of ASCII and Latin-1 letters, and the ends of words.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+|\n"
#: Words that hold nothing else; other words, and those with a special token's '<|', go to the tokeniser whole.
PLAIN = r"^[\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
#: Stands for the end of a word among ids.
WORD_END = 0xFFFFFFFF


class WordIds:
    """Token ids of words, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import re

        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: whether an id ends a run: the vocabulary writes that into the token
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs_of = re.compile(RUNS).findall
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]):
        import numpy as np

        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in got]

    def _learn(self, runs: list[str]) -> None:
        """Tokenises runs by the hundreds in one text, cut apart again at the ids that end a run."""
        import numpy as np

        for at in range(0, len(runs), 500):
            some = runs[at : at + 500]
            (ids,) = self._encode([" ".join(some)])
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(some):
                data = ids.tobytes()
                self.known.update(zip(some, (data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))))
            else:
                self.known.update(zip(some, (x.tobytes() for x in self._encode(some))))

    def of(self, words):
        """(ids, first, size): the ids of all words (an Arrow array of distinct ones), and where each word's lie."""
        import numpy as np
        import pyarrow.compute as pc

        if len(self.known) > RUNS_KEPT:
            self.known.clear()
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        runs = self.runs_of("".join(f"{w}\n" for w in words.filter(plain).to_pylist()).lower())
        self._learn(sorted(set(runs) - self.known.keys() - {"\n"}))
        self.known["\n"] = WORD_END.to_bytes(4, "little")
        stream = np.frombuffer(b"".join(map(self.known.__getitem__, runs)), "<u4")
        ends = np.flatnonzero(stream == WORD_END)
        odd = self._encode(words.filter(pc.invert(plain)).to_pylist())
        sizes = np.concatenate([np.diff(ends, prepend=-1) - 1, np.array([len(x) for x in odd], np.int64)])
        starts = np.cumsum(sizes) - sizes
        mask = plain.to_numpy(zero_copy_only=False)
        row = np.empty(len(mask), np.int64)
        row[mask], row[~mask] = np.arange(mask.sum()), mask.sum() + np.arange((~mask).sum())
        return np.concatenate([stream[stream != WORD_END], *odd]), starts[row], sizes[row]


def piece_lengths(tokens: int, max_len: int) -> list[int]:
    """Binary decomposition, longest first: as many max_len as fit, then the set bits of the rest."""
    whole, rest = divmod(tokens, max_len)
    return [max_len] * whole + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(tokenizer_path: str, max_len: int, end_id: int):
    def run(batches):
        import os

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = WordIds(tokenizer_path)
        partition, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in sliced(batch, "text", SLICE):
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                words = pc.ascii_split_whitespace(texts)
                coded = words.flatten().dictionary_encode()
                flat, first, size = known.of(coded.dictionary)
                codes = coded.indices.to_numpy(zero_copy_only=False)
                # tokens of each word in turn, and where each document's words end
                n = size[codes]
                ends = np.cumsum(n)
                shift = (ends - n - first[codes]).astype(np.int32)
                stream = flat[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) - np.repeat(shift, n)]
                last_word = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
                doc_end = np.concatenate([[0], ends])[last_word]
                doc_tokens = np.diff(np.concatenate([[0], doc_end])) + 1
                ids = np.insert(stream, doc_end, end_id)
                cuts = [piece_lengths(int(t), max_len) for t in doc_tokens]
                row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
                length = np.array([x for c in cuts for x in c], dtype=np.int64)
                at = np.cumsum(length) - length
                start = at - np.repeat(np.cumsum(doc_tokens) - doc_tokens, [len(c) for c in cuts])
                bounds = np.concatenate([at, [at[-1] + length[-1]]]) * 4
                bucket = np.log2(length).astype(np.int32)
                number = np.arange(made, made + len(length), dtype=np.int64)
                made += len(length)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()).take(pa.array(row)),
                        pa.array(start),
                        pa.array(length),
                        pa.Array.from_buffers(
                            pa.binary(), len(length), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)]
                        ),
                        pa.array(doc_tokens[row].astype(np.int64)),
                        pa.array(bucket),
                        pa.array((bucket.astype(np.int64) << 59) | (np.int64(partition) << 35) | number),
                        pa.array(np.zeros(len(length), np.int64)),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"],
                )

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of every row of docs (columns doc_id, text; others are ignored).

    ids are the piece's token ids, packed little-endian unsigned 32-bit; bucket is log2(length); sequence_id is
    bucket, input partition and a running number in turn, so sequences of one length have neighbouring identifiers.
    Null or empty text gives one piece with the end id alone; a null doc_id stays null; repeated rows give pieces each;
    an empty table gives none. max_len must be a power of two. docs should be a table or file scan, whose
    partitions come back alike when a task is run again.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    return small_batches(docs.select("doc_id", "text")).mapInArrow(_packer(tokenizer_path, max_len, end_id), PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet, one folder per length, for a length-based curriculum."""
    pieces.write.partitionBy("length").parquet(path)


def op7_packing(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    pieces = pack(docs, tokenizer_path)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
