"""Vector best-fit packing of token sequences.

Documents become token ids and one end id; only documents longer than the capacity are cut. Pieces of full length are a sequence each. The
others are dealt to groups of bounded size and packed there, longest first: a piece goes to the open bin where what is left
of the token, document and attention-cost capacities has the smallest weighted norm, among bins that can hold it under every
one of them.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import giving_back, giving_back_group, text_blocks, written

END = 1
CACHE = 150_000
#: Pieces that one group packs: a group leaves about one bin that is not full.
GROUP = 8_000

#: Capacities of a sequence besides its tokens, and the weights of tokens, documents and attention cost in the norm of what stays free.
MOST_DOCUMENTS, WEIGHTS = 256, (1.0, 0.05, 0.05)

_encoders: dict[str, "Words"] = {}


#: Words that are encoded without the tokenizer's own splitting: Latin letters, then punctuation that its pattern keeps together.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([-!\"#$%&()*+,./:;<=>?@^_|~]*)")


#: The steps before the merges for which _PLAIN and lower case say the same; with others the tokenizer encodes every word.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def plain_rules(spec: dict) -> bool:
    """Whether a tokenizer's file has just the steps that _PLAIN stands for."""
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    return normal.get("normalizers") == _NORMAL and before.get("pretokenizers") == [_SPLIT, _BYTES]


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_encoder(spec: dict):
    """A function from a piece of a word to its ids, for a vocabulary that marks ends of words and numbers its merges in order; else None.

    The mark becomes a byte that no UTF-8 text has. As every token comes from one merge and ids rise with merges, merging by the
    least id is merging by rank.
    """
    model, letters = spec.get("model", {}), _byte_letters()
    mark = model.get("end_of_word_suffix")
    if not plain_rules(spec) or model.get("type") != "BPE" or not mark or any(model.get(k) for k in ("byte_fallback", "dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
        return None
    vocab = model["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ids = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(ids, ids[1:])) or (ids and ids[0] <= max(vocab[c] for c in letters)):
        return None
    ranks: dict[bytes, int] = {}
    for token, number in vocab.items():
        if token in special:
            continue
        end = token.endswith(mark)
        body = token.removesuffix(mark)
        if any(c not in letters for c in body):
            return None
        ranks[bytes(letters[c] for c in body) + b"\xff" * end] = number
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Words(dict):
    """Little-endian 32-bit ids by white-space word, for a tokenizer that drops white space; two halves, the older dropped when full."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path) as f:
            self.merge = merge_encoder(json.load(f))
        self.tokenizer, self.older = Tokenizer.from_file(path), {}

    def ids(self, word: bytes) -> list[int]:
        text = word.decode()
        plain = _PLAIN.fullmatch(text) if self.merge else None
        if plain is None:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        found: list[int] = []
        for part in plain.groups():
            if part:
                found += self.merge(part.lower().encode() + b"\xff")
        return found

    def __missing__(self, word: bytes) -> bytes:
        coded = self.older.get(word)
        if coded is None:
            coded = array("I", self.ids(word)).tobytes()
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[word] = coded
        return coded

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, t.encode().split())) for t in texts]


def word_encoder(path: str) -> Words:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Words(path)
    return _encoders[path]


def drops_space(path: str) -> bool:
    """Whether the tokenizer leaves out white space, so that words can be encoded apart."""
    with open(path) as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    return steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed"


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, apart: bool):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(path)
        tail = np.array([END], "<u4").tobytes()
        for batch in text_blocks(batches, 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = words.encode(texts) if apart else [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def vector_best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bin of each row of demand (items by resources), in the order given; a row above the capacity gets a bin alone.

    Bins are chosen by the smallest weighted norm of what stays free, each resource measured by its capacity; ties go to
    the older bin.
    """
    share = demand / capacity
    free = np.empty((max(16, len(demand) // 2), demand.shape[1]))
    bins, used = np.empty(len(demand), np.int64), 0
    live = np.empty(len(free), np.int64)  # bins that may still take something
    n_live = 0
    smallest = np.minimum.accumulate(share[::-1], axis=0)[::-1] if len(share) else share
    for i, need in enumerate(share):
        now = live[:n_live]
        left = free[now] - need
        fits = (left >= -1e-12).all(axis=1)
        if fits.any():
            norm = (left * left * weights).sum(axis=1)
            norm[~fits] = np.inf
            at = int(np.argmin(norm))
            chosen = now[at]
            free[chosen] = left[at]
        else:
            if used == len(free):
                free = np.concatenate([free, np.empty_like(free)])
                live = np.concatenate([live, np.empty_like(live)])
            chosen, at = used, n_live
            free[used] = 1 - need
            live[n_live] = used
            used, n_live = used + 1, n_live + 1
        bins[i] = chosen
        if i + 1 < len(share) and (free[chosen] < smallest[i + 1] - 1e-12).any():
            live[at : n_live - 1] = live[at + 1 : n_live]
            n_live -= 1
    return bins


def _pack(capacity: tuple[float, float, float], weights: tuple[float, float, float]) -> Callable[[pa.Table], pa.Table]:
    @giving_back_group
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = group.column("length").to_numpy().astype(float)
        demand = np.stack([length, np.ones_like(length), length * length], axis=1)
        bins = vector_best_fit(demand, np.array(capacity, float), np.array(weights, float))
        order = np.argsort(bins, kind="stable")
        offset = np.zeros(len(bins), np.int64)
        lengths = length[order].astype(np.int64)
        ahead = np.cumsum(lengths) - lengths
        first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(bins) else np.zeros(0, bool)
        offset[order] = ahead - np.maximum.accumulate(np.where(first, ahead, 0)) if len(bins) else ahead
        number = group.column("bucket").to_numpy().astype(np.int64) * (1 << 32) + bins
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return run


def pack(
    documents: DataFrame,
    path: str,
    capacity: int = 4096,
    most_documents: int | None = MOST_DOCUMENTS,
    most_cost: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    documents needs doc_id and text; other columns are ignored. A null text is empty and gives a piece of the end id alone.
    Rows that repeat a doc_id are packed each. most_documents and most_cost (the sum of squared piece lengths) bound a
    sequence besides its tokens; where they are None they are what the token capacity implies. A bin is chosen by the norm of all three
    residuals, weighted by weights, so that documents and cost decide between bins that tokens leave alike. path is a tokenizers file that every
    executor can read. Runs agree: groups are dealt and packed in an order that the pieces alone fix. An empty table
    gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(docs.mapInArrow(_cut(path, capacity, drops_space(path)), _PIECES), "pieces")
    limits = (float(capacity), float(most_documents or capacity), float(most_cost or capacity * capacity))
    alone = F.col("length") == capacity
    short = pieces.where(~alone)
    groups = max(1, -(-short.count() // GROUP))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    packed = short.withColumn("bucket", bucket.cast("long")).repartition(max(1, min(groups, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "bucket")
    packed = packed.groupBy("bucket").applyInArrow(_pack(limits, weights), _PIECES + ", sequence_id long, offset long")
    number = -1 - F.monotonically_increasing_id()
    return packed.unionByName(pieces.where(alone).withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long")))
