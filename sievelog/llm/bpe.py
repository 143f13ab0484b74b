"""Byte-level BPE by corpus-level merge replay, and the id streams that packing needs.

The distinct pre-tokens of the corpus are gathered by shards of their hashes (``vocabulary``). Those of a shard are laid out
side by side as their bytes. An inverted index leads from each token pair (by the rank of its merge) to its positions in that
layout; merges are replayed in rank order, each on all its positions at once, and only the two neighbours of a merged position
are looked up and indexed anew. Documents then look up the ids of their pre-tokens.

``blocks`` does the same with the distinct pre-tokens of a block of documents, without a shuffle, for operators that need the
ids in passing. The words don't touch each other, so a block gives what the whole corpus would.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import positions, sliced, span_hashes
from .pretokens import pieces
from .vocabulary import Vocabulary, special_documents

#: Bytes of text in a block, of which the distinct pre-tokens are encoded together.
BLOCK_BYTES = 2_000_000
#: Distinct pre-tokens that a worker keeps from block to block.
KEPT = 900_000


class Merges:
    """Vocabulary as rank table. ``path``: a ``.tiktoken`` rank file or a ``tokenizers`` JSON file of a byte-level BPE."""

    def __init__(self, path: str):
        self.path, self.json = path, path.endswith(".json")
        if self.json:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
            alphabet = _byte_alphabet()
            vocab = {bytes(alphabet[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.added}
            merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
            pairs = [(vocab[bytes(alphabet[c] for c in a)], vocab[bytes(alphabet[c] for c in b)], vocab[bytes(alphabet[c] for c in a + b)]) for a, b in merges]
            ranks = list(range(len(pairs)))
        else:
            with open(path, "rb") as f:
                vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.added = {}
            pairs = [(vocab[t[:i]], vocab[t[i:]], r) for t, r in vocab.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in vocab and t[i:] in vocab]
            ranks = [p[2] for p in pairs]
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.single = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        p = np.array(pairs, np.int64)
        keys = p[:, 0] << 32 | p[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], np.array(ranks, np.int64)[order]
        self.made = np.zeros(max(ranks) + 1, np.int64)  # the token of each rank
        self.made[np.array(ranks)] = p[:, 2]
        # an open hash of the pairs: a slot has the place of its pair, or -1
        self.bits = 22
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(self.keys)), self._slot(self.keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            lost = self.slots[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.by_id = [b""] * self.size
        for t, i in vocab.items():
            self.by_id[i] = t
        for t, i in self.added.items():
            self.by_id[i] = t.encode()
        self.id_len = np.array([len(t) for t in self.by_id], np.int64)
        self.id_at = np.cumsum(self.id_len) - self.id_len
        self.id_bytes = np.frombuffer(b"".join(self.by_id), np.uint8)
        self.whole = vocab
        self.apart = np.zeros(0, np.uint64)  # hashes of the tokens that are looked up as whole words
        if not self.json:
            long = [t for t in vocab if len(t) > 1]
            lens = np.array([len(t) for t in long])
            begin = np.cumsum(lens) - lens
            self.apart = np.sort(span_hashes(np.frombuffer(b"".join(long), np.uint8), begin, begin + lens))
        self.reset()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def reset(self) -> None:
        self.kept, self.kept_check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.kept_at, self.kept_n, self.kept_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where there is no merge."""
        keys = left << 32 | right
        out = np.full(len(keys), -1, np.int64)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            place = self.slots[at]
            found = place >= 0
            rest, at, place = rest[found], at[found], place[found]
            same = self.keys[place] == keys[rest]
            out[rest[same]] = self.rank_of[place[same]]
            rest, at = rest[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def one(self, word: bytes) -> list[int]:
        """A single word, pair by pair: for the few words whose merges a replay by rank can't put in order."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            r = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
            if not (r >= 0).any():
                break
            i = int(np.where(r < 0, 1 << 60, r).argmin())
            ids[i : i + 2] = [int(self.made[r[i]])]
        return ids

    def replay(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each word's. ``flat``: their bytes; ``lens``: over 0."""
        n = len(flat)
        ids = self.single[flat]
        word = np.repeat(np.arange(len(lens)), lens)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(lens) - 1
        after[last] = -1
        before[last - lens + 1] = -1
        rank = np.full(n + 1, -1, np.int64)  # of the pair that begins here; the last entry takes what goes to no neighbour
        has = np.flatnonzero(after >= 0)
        rank[has] = self.ranks(ids[has], ids[has + 1])
        alive = np.ones(n, bool)
        odd: set[int] = set()  # words to do again one by one
        found = np.flatnonzero(rank[:n] >= 0)
        found = found[np.argsort(rank[found], kind="stable")]
        values, begin = np.unique(rank[found], return_index=True)
        index = {int(v): [p] for v, p in zip(values, np.split(found, begin[1:]), strict=True)} if len(values) else {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            nxt = after[at]
            if len(at) > 1 and len(chained := np.flatnonzero(rank[nxt] == r)):  # pairs of one rank that overlap: from the left
                taken, drop = -1, []
                starts = set(nxt[chained].tolist())
                for p, q in zip(at.tolist(), nxt.tolist(), strict=True):
                    if p in starts and p == taken:
                        drop.append(p)
                        taken = -1
                    else:
                        taken = q
                keep = ~np.isin(at, drop)
                at, nxt = at[keep], nxt[keep]
            far = after[nxt]
            ids[at] = self.made[r]
            after[at] = far
            some = far >= 0
            before[far[some]] = at[some]
            alive[nxt] = False
            rank[nxt] = -1
            rank[at] = -1
            prior = before[at]
            a, b = at[some], prior[prior >= 0]
            touched = np.concatenate([a, b])
            if not len(touched):
                continue
            new = self.ranks(ids[touched], ids[after[touched]])
            rank[touched] = new
            live = new >= 0
            if not live.any():
                continue
            touched, new = touched[live], new[live]
            if (early := new <= r).any():
                odd.update(word[touched[early]].tolist())
            if len(new) == 1:
                groups = [(int(new[0]), touched)]
            else:
                order = np.argsort(new, kind="stable")
                new, touched = new[order], touched[order]
                cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
                groups = zip(new[np.concatenate([[0], cuts])].tolist(), np.split(touched, cuts), strict=True)
            for v, p in groups:
                if v in index:
                    index[v].append(p)
                else:
                    index[v] = [p]
                    heapq.heappush(heap, v)
        counts = np.bincount(word[alive], minlength=len(lens))
        ids = ids[alive].astype(np.int32)
        if odd:
            begin, place, out = np.cumsum(lens) - lens, np.cumsum(counts) - counts, []
            was = 0
            for w in sorted(odd):
                again = self.one(flat[begin[w] : begin[w] + lens[w]].tobytes())
                out += [ids[was : place[w]], np.array(again, np.int32)]
                was = place[w] + counts[w]
                counts[w] = len(again)
            ids = np.concatenate([*out, ids[was:]])
        return ids, counts

    def encoded(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As replay; a rank file's word that is a token as a whole is that token, as its library has it."""
        ids, counts = self.replay(flat, lens)
        if len(self.apart) and len(lens):
            begin, more = np.cumsum(lens) - lens, np.flatnonzero(counts > 1)
            again = more[np.isin(span_hashes(flat, begin[more], (begin + lens)[more]), self.apart)]
            place, keep = np.cumsum(counts) - counts, np.ones(len(ids), bool)
            for w in again.tolist():
                ids[place[w]] = self.whole[flat[begin[w] : begin[w] + lens[w]].tobytes()]
                keep[place[w] + 1 : place[w] + counts[w]] = False
                counts[w] = 1
            ids = ids[keep]
        return ids, counts

    def learn(self, hashes: np.ndarray, check: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        """Encodes words that aren't kept yet; ``hashes`` are distinct, ``check`` is 64 bits more of each word."""
        if not len(hashes):
            return
        ids, counts = self.encoded(flat, lens)
        at = len(self.kept_ids) + np.cumsum(counts) - counts
        hashes = np.concatenate([self.kept, hashes])
        order = np.argsort(hashes)
        self.kept_check = np.concatenate([self.kept_check, check])[order]
        self.kept, self.kept_at, self.kept_n = hashes[order], np.concatenate([self.kept_at, at])[order], np.concatenate([self.kept_n, counts])[order]
        self.kept_ids = np.concatenate([self.kept_ids, ids])

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words are among those kept, and which of them are there."""
        if not len(self.kept):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        i = np.minimum(np.searchsorted(self.kept, hashes), len(self.kept) - 1)
        return i, self.kept[i] == hashes

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, one after the other, and where each id's begin."""
        n = self.id_len[ids]
        index, _, first = positions(self.id_at[ids], n)
        return self.id_bytes[index], first

    @property
    def library(self):
        return _library(self.path)


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _library(path: str):
    """text -> ids by the library itself."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def merges(path: str) -> Merges:
    return Merges(path)


class Block:
    """Documents with the pre-tokens of each as numbers of distinct ones. Words are told apart by 128 bits: documents with a
    word whose first 64 are another word's too are left to the library, as are those with a special token's text."""

    def __init__(self, table: Merges, columns: list[str]):
        self.table, self.columns = table, columns
        self.rows: list[pa.RecordBatch] = []
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []
        self.codes: list[tuple[np.ndarray, np.ndarray]] = []  # of a slice's pre-tokens: numbers of distinct hashes, and those
        self.firsts: list[np.ndarray] = []
        self.special: list[np.ndarray] = []
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.clash: list[np.ndarray] = []
        self.bytes = 0

    def add(self, rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> None:
        starts, ends, first = pieces(data, off)
        hashes, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, 1)
        codes, distinct = pd.factorize(hashes)
        here = np.empty(len(distinct), np.int64)
        here[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        self.clash.append(hashes[check != check[here][codes]])
        i, known = self.table.known(distinct)
        if known.any():
            self.clash.append(distinct[known][self.table.kept_check[i[known]] != check[here][known]])
        new, here = distinct[~known], here[~known]
        lens = ends[here] - starts[here]
        index, _, _ = positions(starts[here], lens)
        self.new.append((new, check[here], lens, data[index]))
        self.rows.append(rows.select(self.columns))
        self.texts.append((data, off))
        self.codes.append((codes.astype(np.int32), distinct))
        self.firsts.append(first)
        self.special.append(special_documents(self.table.added, data, off))
        self.bytes += len(data)

    def finish(self) -> None:
        """Encodes the distinct pre-tokens that are new."""
        hashes, check, lens, flat = (np.concatenate(x) for x in zip(*self.new, strict=True))
        distinct, at, codes = np.unique(hashes, return_index=True, return_inverse=True)
        self.clash.append(hashes[check != check[at][codes]])
        begin = np.cumsum(lens) - lens
        index, _, _ = positions(begin[at], lens[at])
        self.new = []
        self.table.learn(distinct, check[at], flat[index], lens[at])

    def ids(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice: the rows, the ids of its documents one after the other, where each document's begin (one more entry), and their bytes."""
        t, clash = self.table, np.concatenate(self.clash)
        for rows, (data, off), (codes, distinct), first, special in zip(self.rows, self.texts, self.codes, self.firsts, self.special, strict=True):
            i, _ = t.known(distinct)
            n = t.kept_n[i][codes]
            index, _, _ = positions(t.kept_at[i][codes], n)
            ids = t.kept_ids[index]
            begin = np.concatenate([[0], np.cumsum(n)])[first]
            if len(clash) and (bad := np.isin(distinct, clash)[codes]).any():
                special = np.union1d(special, np.searchsorted(first, np.flatnonzero(bad), "right") - 1)
            ids, begin = with_library(t.library, ids, begin, special, data, off)
            yield rows, ids, begin, np.diff(off)
        if len(t.kept) > KEPT:
            t.reset()


def with_library(library, ids: np.ndarray, begin: np.ndarray, some: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice, those of ``some`` documents as the library gives them."""
    if not len(some):
        return ids, begin
    own = {d: np.array(library(data[off[d] : off[d + 1]].tobytes().decode()), np.int32) for d in some.tolist()}
    parts = [own[d] if d in own else ids[begin[d] : begin[d + 1]] for d in range(len(off) - 1)]
    return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def blocks(batches: Iterator[pa.RecordBatch], path: str, columns: list[str], column: str = "text") -> Iterator[Block]:
    table = merges(path)
    block = Block(table, columns)
    for rows, data, off in sliced(batches, column):
        block.add(rows, data, off)
        if block.bytes >= BLOCK_BYTES:
            block.finish()
            yield block
            block = Block(table, columns)
    if block.rows:
        block.finish()
        yield block


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids and decoded bytes of every whole text: (id, token_ids array<int>, decoded binary).

    Null text: as empty. Equal rows give equal rows each; an empty table gives none; other columns aren't looked at. A long
    text is one row of one task.
    """
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, token_ids array<int>, decoded binary"
    known = Vocabulary(docs, path, text_column, keep_ids=True)

    def run(batches):
        for rows, ids, begin in known.ids_of(batches, text_column):
            raw, at = merges(path).decoded(ids)
            cut = np.append(at, len(raw))[begin]
            yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32())), pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])], [id_column, "token_ids", "decoded"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text; the ids themselves don't leave the task. Odd rows as in
    ``encode_documents``."""
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    known = Vocabulary(docs, path, text_column, keep_ids=True)

    def run(batches):
        for rows, ids, begin in known.ids_of(batches, text_column):
            raw, at = merges(path).decoded(ids)
            cut = np.append(at, len(raw))[begin].tolist()
            wide, edge = np.ascontiguousarray(ids, "<u4").tobytes(), (begin * 4).tolist()
            plain = raw.tobytes()
            a = [hashlib.sha256(wide[edge[d] : edge[d + 1]]).hexdigest() for d in range(rows.num_rows)]
            b = [hashlib.sha256(plain[cut[d] : cut[d + 1]]).hexdigest() for d in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(np.diff(begin), pa.int64()), pa.array(a), pa.array(b)], [id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
