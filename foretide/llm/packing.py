"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents turn into pieces where they are read: token ids plus one end id, cut only where longer than a sequence.
Only the pieces' lengths travel on, each with its number of arrival. They are dealt by a hash of that number, so repeated
or missing ids spread as well as any, into shards of about `SHARD_BINS` sequences. Each shard packs its pieces in order
of arrival by bounded-space best-fit: at most `OPEN_BINS` bins are open, their free spaces are the set bits of one
integer, a piece goes to the open bin with the least sufficient space, and where a new bin is one too many the fullest
closes first. A shard's open bins at its end are its only loss, a few in some thousand.

Rows: a null or empty text is one piece of the end id alone. Repeated ids are packed as documents of their own (their
pieces can't be told apart then). A text without white space is tokenised whole. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import stored, text_batches

CAPACITY = 4096
#: Bins open at once, and sequences of a shard, about.
OPEN_BINS, SHARD_BINS = 64, 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: ASCII signs that always begin or end a token of their own beside letters.
_SIGNS = b".,;:!?|#$%&*\"()[]{}<>=+-_/\\@^~`"
#: Words of letters that are encoded in one call, as one text.
TOGETHER = 200


class TokenBytes(dict):
    """Word (bytes without ASCII white space) -> its ids as little-endian unsigned 32-bit.

    For tokenizers that drop white space and case and end each token's last piece with a mark, such as "</w>". Words are
    letters between signs mostly; unseen runs of letters are encoded together and told apart by the mark.
    """

    def __init__(self, path: str, most: int = 600_000, mark: str = "</w>"):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd: set[bytes] = set()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Encode the unseen words of a batch."""
        new = words - self.keys()
        if len(self) + len(new) > self.most:
            self.clear()
            new = words
        letters, signed, other = set(), [], set()
        for w in new:
            core = w.strip(_SIGNS)
            if not (core.isalpha() or core and not core.isascii() and core.decode().isalpha()):
                other.add(w)
            elif len(core) == len(w):
                letters.add(w)
            elif b"<|" in w and any(t in w for t in self.special):
                other.add(w)
            else:
                at = w.index(core)
                signed.append((w, w[:at], core, w[at + len(core) :]))
        letters.update([core for _, _, core, _ in signed])
        self._together(list(letters - self.keys()))
        other.update([head for _, head, _, _ in signed], [end for *_, end in signed])
        if self.odd:
            other.update([w for w, _, core, _ in signed if core in self.odd])
        rest = [x for x in other if x not in self]
        self.update(zip(rest, (e.tobytes() for e in self.encode([x.decode() for x in rest]))))
        for w, head, core, end in signed:
            if core not in self.odd:
                self[w] = self[head] + self[core] + self[end]

    def _together(self, cores: list[bytes]) -> None:
        groups = [cores[i : i + TOGETHER] for i in range(0, len(cores), TOGETHER)]
        for group, found in zip(groups, self.encode([b" ".join(g).decode() for g in groups])):
            cut = np.flatnonzero(self.ends[found]) + 1
            if len(cut) == len(group):
                raw, at = found.tobytes(), 0
                for c, to in zip(group, (4 * cut).tolist()):
                    self[c] = raw[at:to]
                    at = to
            else:  # some run of letters is more than letters once normalised: its words are encoded whole
                for c, e in zip(group, self.encode([c.decode() for c in group])):
                    self[c] = e.tobytes()
                    if self.ends[e].sum() != 1:
                        self.odd.add(c)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) -> the pieces of each document, where the documents are read, and their number of arrival."""

    def cut(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known, end = TokenBytes(tokenizer), np.asarray([end_id], "<u4").tobytes()
        arrived = TaskContext.get().partitionId() << 40
        for batch in text_batches(batches):
            out = [[], [], [], [], []]
            # ASCII case makes no difference but to the special tokens, which are told apart by it
            split = [(t if b"<|" in t else t.lower()).split() for t in batch.column("text").fill_null("").cast(pa.binary()).to_pylist()]
            known.learn(set().union(*split))
            for doc, words in zip(batch.column("doc_id").to_pylist(), split):
                ids = b"".join(map(known.__getitem__, words)) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))), pa.array(np.arange(arrived, arrived + n))], names=["doc_id", "piece", "start", "length", "ids_crc32", "arrival"])
            arrived += n

    return docs.select("doc_id", "text").mapInArrow(cut, f"{PIECES}, arrival long")


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int], list[int], int]:
    """Bin and offset of each length, in the order given, how full each bin became, and how many were closed to make room."""
    bits, by_space, n_open, closed = 0, [[] for _ in range(capacity + 1)], 0, 0
    bins, offsets, full = [], [], []
    for length in lengths:
        room = bits >> length
        if room:
            space = length + (room & -room).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                bits ^= 1 << space
            n_open -= 1
        else:
            if n_open >= open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_space[fullest].pop()
                if not by_space[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
                closed += 1
            b, space = len(full), capacity
            full.append(0)
        bins.append(b)
        offsets.append(full[b])
        full[b] += length
        if left := space - length:
            by_space[left].append(b)
            bits |= 1 << left
            n_open += 1
    return bins, offsets, full, closed


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_bins: int = SHARD_BINS) -> DataFrame:
    """docs (doc_id, text) -> one row per piece with its sequence and its offset there."""
    cut = stored(pieces(docs, tokenizer, capacity=capacity))
    tokens = cut.agg(F.sum("length")).first()[0] or 0  # one number
    shards = max(1, -(-tokens // (capacity * shard_bins)))

    def packed(pdf):
        pdf = pdf.sort_values("arrival")
        bins, offsets, *_ = best_fit(pdf["length"].tolist(), capacity, open_bins)
        # no shard has that many pieces
        return pdf.drop(columns=["arrival", "shard"]).assign(sequence_id=np.asarray(bins, np.int64) + (int(pdf["shard"].iloc[0]) << 32), offset=offsets)

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("arrival"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(packed, f"{PIECES}, sequence_id long, offset long")
