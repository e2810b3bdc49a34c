"""Blocks of an index, as Arrow batches: the postings of a block's texts, and the best documents of queries block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .score import B, K1

#: Room for sums in another order, and for rounding to six places.
ROOM = 2e-6
#: Documents that are scored together, scores in memory, and hits that a task holds before it cuts them.
DOCS, SCORES, HELD = 512, 1 << 22, 1 << 18
#: Tokens, and texts, that a task cuts into blocks together where it scans them, and texts of such a block.
SLICE_TOKENS, SLICE_TEXTS, SLICE_BLOCK = 1 << 21, 1 << 15, 1 << 11


def impact(tf, length, average):
    """What BM25 makes of a count and a length, without the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def one(column: pa.ChunkedArray) -> pa.Array:
    """The column as one array."""
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _postings(texts: DataFrame, group: str, doc: str, carry: str | None, positions: bool, asked=None):
    """(what makes a block's rows of its texts, their schema); ``asked``, a broadcast array of terms, leaves out the postings of others."""
    kind = lambda c: texts.schema[c].dataType
    integers = T.ArrayType(T.IntegerType())
    fields = [(group, kind(group)), ("term", T.StringType()), ("block", T.IntegerType()), ("n", T.LongType()), ("top", T.DoubleType()), ("at", integers), ("tfs", integers)]
    fields += [("positions", T.ArrayType(integers))] if positions else []
    fields += [("docs", T.ArrayType(kind(doc)))] + ([("carried", T.ArrayType(kind(carry)))] if carry else []) + [("lens", integers)]

    def postings(table: pa.Table) -> pa.Table:
        table = table.sort_by([(group, "ascending"), (doc, "ascending")])
        n, tokens = table.num_rows, one(table["tokens"])
        counts = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        words, at = tokens.flatten(), np.repeat(np.arange(n), counts)
        if asked is not None:
            known = pc.is_in(words, value_set=asked.value)
            words, at = words.filter(known), at[known.to_numpy(zero_copy_only=False)]
        words = words.dictionary_encode()
        # by word, then text; a text's places stay in order
        key = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + at
        if positions:
            order = np.argsort(key, kind="stable")
            key, pos = key[order], ranges(np.zeros(n, np.int64), counts)[order].astype(np.int32)
        else:
            key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        word, row = key[starts] // max(n, 1), key[starts] % max(n, 1)
        tfs = np.diff(starts, append=len(key)).astype(np.int32)
        lens = one(table["len"]).to_numpy()[row]
        owners = one(table[group]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        groups = owners[row]
        firsts = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(groups, prepend=-1) != 0))
        tops = np.maximum.reduceat(impact(tfs, lens, one(table["_avg"]).to_numpy()[row]), firsts) if len(firsts) else np.zeros(0)
        offsets = pa.array(np.append(firsts, len(row)).astype(np.int32))
        lists = lambda values: pa.ListArray.from_arrays(offsets, values)
        # a group's texts stand together: their places are counted from its first
        begins = np.flatnonzero(np.diff(owners, prepend=-1))
        places = np.arange(n) - np.repeat(begins, np.diff(begins, append=n))
        heads = pa.array(row[firsts])
        out = [one(table[group]).take(heads), words.dictionary.take(pa.array(word[firsts])), one(table["block"]).take(heads)]
        out += [pa.array(np.diff(np.append(firsts, len(row))).astype(np.int64)), pa.array(tops), lists(pa.array(places[row].astype(np.int32))), lists(pa.array(tfs))]
        out += [lists(pa.ListArray.from_arrays(pa.array(np.append(starts, len(pos)).astype(np.int32)), pa.array(pos)))] if positions else []
        texts_of = lambda values: pa.ListArray.from_arrays(pa.array(np.append(begins, n).astype(np.int32)), values)
        members = {group: one(table[group]).take(pa.array(begins)), "block": one(table["block"]).take(pa.array(begins)), "n": pa.array(np.diff(np.append(begins, n)).astype(np.int64)), "docs": texts_of(one(table[doc]))}
        members |= {"carried": texts_of(one(table[carry]))} if carry else {}
        members |= {"lens": texts_of(one(table["len"]).cast(pa.int32()))}
        head = pa.Table.from_arrays(out, names=[f for f, _ in fields[: len(out)]])
        return pa.concat_tables([head, pa.table(members)], promote_options="default").select([f for f, _ in fields])

    return postings, T.StructType([T.StructField(*f) for f in fields])


def written(texts: DataFrame, group: str, doc: str, carry: str | None, positions: bool = True) -> DataFrame:
    """group, term, block, n, top and arrays at, tfs (, positions) of texts (group, doc, (carry,) len, block, tokens, _avg), which are partitioned by block.

    Rows without a term hold the arrays docs, (carried,) lens of a group and block, and n, the number of its texts; places are those in these arrays.
    """
    postings, schema = _postings(texts, group, doc, carry, positions)
    return texts.groupBy("block").applyInArrow(postings, schema)


@dataclass(frozen=True)
class Scan:
    """Rows of blocks that ``run`` makes of texts, in the tasks that scan them."""

    texts: DataFrame
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: T.StructType


def _asking(schema: T.StructType, kind: T.DataType) -> T.StructType:
    """The schema with what rows of queries and of static values hold."""
    return T.StructType([*schema.fields, T.StructField("query_id", kind), T.StructField("values", T.ArrayType(T.DoubleType()))])


def _completed(table: pa.Table, schema: T.StructType) -> pa.Table:
    for c in schema.names:
        if c not in table.column_names:
            table = table.append_column(c, pa.nulls(table.num_rows))
    return table.select(schema.names).combine_chunks()


def scanned(texts: DataFrame, group: str, doc: str, carry: str | None, asked: pa.Array, kind: T.DataType) -> Scan:
    """As ``written``, of the asked terms alone and without positions; texts (group, doc, (carry,) len, tokens, _avg) stay in the tasks that scan them.

    A task's texts are cut into blocks by length, slice by slice; blocks are numbered within the task, and their rows come one block after another.
    """
    postings, schema = _postings(texts, group, doc, carry, False, texts.sparkSession.sparkContext.broadcast(asked))
    schema = _asking(schema, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for held in _slices(batches):
            table = pa.Table.from_batches(held).sort_by([("len", "ascending")])
            for start in range(0, table.num_rows, SLICE_BLOCK):
                part = table.slice(start, SLICE_BLOCK)
                yield from _completed(postings(part.append_column("block", pa.array(np.full(part.num_rows, number, np.int32)))), schema).to_batches()
                number += 1

    return Scan(texts, run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches' rows, of ``len`` tokens each, in slices of bounded size, one row at least."""
    held: list[pa.RecordBatch] = []
    rows_held = tokens_held = 0
    for batch in batches:
        ends = np.cumsum(batch.column("len").to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_TOKENS - tokens_held, "right"))
            stop = min(max(start + (not held), stop), start + SLICE_TEXTS - rows_held)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                tokens_held, rows_held = tokens_held + int(ends[stop - 1] - before), rows_held + stop - start
                start = stop
            if start < batch.num_rows:  # the slice is full
                yield held
                held, rows_held, tokens_held = [], 0, 0
    if held:
        yield held


class Phrases:
    """The phrases of queries as a trie of their words; all phrases at hand are found in texts by one walk over the places where one may begin."""

    def __init__(self, phrases: pa.Table):
        """phrases: query_id and tokens, once each; none is empty."""
        tokens, coded = one(phrases["tokens"]), one(phrases["query_id"]).dictionary_encode()
        self.queries = coded.dictionary
        self.words = pc.unique(tokens.flatten())
        codes = pc.index_in(tokens.flatten(), value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64))
        steps: dict[int, int] = {}
        last = np.zeros(len(tokens), np.int64)
        for number, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            node = 0
            for code in codes[begin:end].tolist():
                node = steps.setdefault(node * len(self.words) + code, len(steps) + 1)
            last[number] = node
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        # the queries whose phrase ends at each node
        order = np.argsort(last, kind="stable")
        self.asker = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        self.counts = np.bincount(last, minlength=len(steps) + 1)
        self.starts = np.cumsum(self.counts) - self.counts

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node behind each word, or -1."""
        key = node * len(self.words) + code
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((code >= 0) & (self.keys[place] == key), self.next[place], -1)

    def found(self, tokens: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, owner, number of the query's phrases that some text of the owner holds), each query and owner once; lists of tokens and their owners."""
        counts = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        first = self.step(np.zeros(len(self.words), np.int64), np.arange(len(self.words)))
        at = np.flatnonzero(np.append(first, -1)[code] >= 0)
        node, size, met = first[code[at]], int(owner.max(initial=0)) + 1, []
        while len(at):
            done = self.counts[node] > 0
            met.append(np.unique(node[done] * size + owner[text[at[done]]]))
            more = at + 1 < ends[text[at]]
            at, node = at[more] + 1, node[more]
            node = self.step(node, code[at])
            at, node = at[node >= 0], node[node >= 0]
        pairs = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        many = self.counts[pairs // size]
        asked = self.asker[ranges(self.starts[pairs // size], many)] * size + np.repeat(pairs % size, many)
        each, n = np.unique(asked, return_counts=True)
        return each // size, each % size, n


def scanned_documents(docs: DataFrame, group: str, doc: str, averages: dict, asked: pa.Array, phrases: Phrases | None, bonus: float, kind: T.DataType) -> Scan:
    """As ``scanned``, of documents (doc, static, ``texts``, an array of (group, tokens), and len, all their tokens) whose texts are scored together.

    Blocks are cut by falling static values, which rows of theirs hold, and further rows (query_id, docs, values) hold ``bonus`` for each of a query's phrases in a document.
    """
    plain = docs.select(doc, F.lit(None).cast(docs.schema["texts"].dataType.elementType[group].dataType).alias(group))
    postings, schema = _postings(plain, group, doc, None, False, docs.sparkSession.sparkContext.broadcast(asked))
    schema = _asking(schema, kind)
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(list(averages)), np.array(list(averages.values()), float), phrases))

    def rows(part: pa.Table, number: int) -> pa.Table:
        names, means, wanted = shared.value
        texts, keys = one(part["texts"]), one(part[doc])
        own = np.repeat(np.arange(part.num_rows), pc.list_value_length(texts).to_numpy(zero_copy_only=False))
        groups, tokens = texts.flatten().flatten()
        columns = {group: groups, doc: keys.take(pa.array(own)), "len": pc.list_value_length(tokens), "tokens": tokens, "block": pa.array(np.full(len(own), number, np.int32))}
        columns["_avg"] = pa.array(means[pc.index_in(groups, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)])
        ends = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        out = [postings(pa.table(columns))]
        static = one(part["static"])
        out.append(pa.table({"block": pa.array([number], pa.int32()), "docs": pa.ListArray.from_arrays(ends([len(keys)]), keys), "values": pa.ListArray.from_arrays(ends([len(keys)]), static)}))
        if wanted is not None:
            query, at, n = wanted.found(tokens, own)
            asker, many = np.unique(query, return_counts=True)
            out.append(pa.table({"query_id": wanted.queries.take(pa.array(asker)), "block": pa.array(np.full(len(asker), number, np.int32)), "docs": pa.ListArray.from_arrays(ends(many), keys.take(pa.array(at))), "values": pa.ListArray.from_arrays(ends(many), pa.array(n * bonus))}))
        return _completed(pa.concat_tables(out, promote_options="default"), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for held in _slices(batches):
            table = pa.Table.from_batches(held).sort_by([("static", "descending")])
            for start in range(0, table.num_rows, DOCS):
                yield from rows(table.slice(start, DOCS), number).to_batches()
                number += 1

    return Scan(docs, run, schema)


class Side:
    """The weights of a batch of queries: for each key (group and term) its slots, and for each query its slots, whose values are summed.

    A slot is a word of queries with its weight, in a group; queries that share both share it. A slot's value in a document is the largest of its terms'.
    """

    def __init__(self, keys: pa.Array, groups: np.ndarray, words: np.ndarray, queries: np.ndarray, weights: np.ndarray, averages: np.ndarray, n: int):
        self.n = n
        coded = keys.dictionary_encode()
        self.keys, key = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.average = np.zeros(len(self.keys))
        self.average[key] = averages
        # a query's word in a group, told apart by the weight of its first term
        order = np.lexsort((key, words, groups, queries))
        key, groups, words, queries, weights = (x[order] for x in (key, groups, words, queries, weights))
        first = np.ones(len(key), bool)
        first[1:] = (queries[1:] != queries[:-1]) | (groups[1:] != groups[:-1]) | (words[1:] != words[:-1])
        owner = np.cumsum(first) - 1
        signature = np.stack([groups[first].astype(float), words[first].astype(float), key[first].astype(float), weights[first]], axis=1) if len(key) else np.zeros((0, 4))
        _, one, slot = np.unique(signature, axis=0, return_index=True, return_inverse=True)
        slot = slot.reshape(-1)
        self.slots = len(one)
        self.of_query, asked = slot, queries[first]
        self.counts = np.bincount(asked, minlength=n)
        chosen = np.zeros(int(owner[-1]) + 1 if len(owner) else 0, bool)
        chosen[one] = True
        mine = chosen[owner]
        by = np.argsort(key[mine], kind="stable")
        self.slot, self.weight = slot[owner[mine]][by], weights[mine][by]
        self.sizes = np.bincount(key[mine], minlength=len(self.keys))
        self.starts = np.cumsum(self.sizes) - self.sizes


class Hits:
    """The hits of queries so far: those that may be among the k best of each, of equal scores the k first by document."""

    def __init__(self, n: int, k: int | None):
        self.k, self.floor, self.parts, self.size, self.limit = k, np.full(n, -np.inf), [], 0, HELD

    def add(self, queries: np.ndarray, scores: np.ndarray, docs: pa.Array, carried: pa.Array | None) -> None:
        self.parts.append((queries, scores, docs, carried))
        self.size += len(queries)

    def table(self) -> pa.Table | None:
        if not self.parts:
            return None
        columns = [pa.array(np.concatenate([p[i] for p in self.parts])) for i in (0, 1)] + [pa.concat_arrays([p[i] for p in self.parts]) for i in (2, 3) if self.parts[0][i] is not None]
        return pa.table(columns, names=["query", "score", "doc", "carried"][: len(columns)])

    def cut(self) -> pa.Table | None:
        table = self.table()
        if table is None or self.k is None:
            return table
        table = table.sort_by([("query", "ascending"), ("score", "descending"), ("doc", "ascending")])
        query, score = (one(table[c]).to_numpy() for c in ("query", "score"))
        first = np.flatnonzero(np.diff(query, prepend=-1))
        sizes = np.diff(first, append=len(query))
        full = sizes >= self.k
        self.floor[query[first[full]]] = score[first[full] + self.k - 1] - ROOM
        new = (np.diff(query, prepend=-1) != 0) | (np.diff(score, prepend=np.nan) != 0)
        begins = np.flatnonzero(new)
        within = np.arange(len(query)) - np.repeat(begins, np.diff(begins, append=len(query)))
        table = table.take(pa.array(np.flatnonzero((score >= self.floor[query]) & (within < self.k))))
        self.parts = [(one(table["query"]).to_numpy(), one(table["score"]).to_numpy(), one(table["doc"]), one(table["carried"]) if "carried" in table.column_names else None)]
        self.size = table.num_rows
        self.limit = max(HELD, 2 * self.size)
        return table


def _sides(index, heavy: DataFrame, queries: pa.Array, apart: bool) -> dict:
    """Side by group, or one for all."""
    table = heavy.select("query_id", "word", F.col(index.group).alias("g"), "term", "_weight", "_avg").toArrow()
    column = {c: one(table[c]) for c in table.column_names}
    groups, words = (column[c].dictionary_encode() for c in ("g", "word"))
    codes = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (groups, words)]
    asked = pc.index_in(column["query_id"], value_set=queries).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.binary_join_element_wise(column["g"].cast(pa.string()), column["term"], "\0")
    weights, averages = (column[c].to_numpy(zero_copy_only=False) for c in ("_weight", "_avg"))
    out = {}
    for number, name in enumerate(groups.dictionary.to_pylist() if apart else [None]):
        at = np.flatnonzero(codes[0] == number) if apart else np.arange(table.num_rows)
        out[name] = Side(keys.take(pa.array(at)), codes[0][at], codes[1][at], asked[at], weights[at], averages[at], len(queries))
    return out


def best(rows: DataFrame | Scan, index, heavy: DataFrame, asking: DataFrame, only: tuple | None, k: int | None, apart: bool, factors: bool, probe: int, kind: T.DataType) -> DataFrame:
    """query_id, (group,) doc, (carry,) score of rows of which each partition holds whole blocks, one after another: the hits that may be among the k best; all if k is None.

    ``index`` names the columns group, doc and carry.
    """
    spark, group = heavy.sparkSession, index.group
    queries = pc.unique(one(asking.select("query_id").distinct().toArrow()["query_id"]))
    sides = _sides(index, heavy, queries, apart)
    limits = None
    if only is not None:  # a bounded list for each query
        held, pairs = only[0].select("query_id").distinct().toArrow(), only[1].toArrow()
        restricted = np.zeros(len(queries), bool)
        known = pc.index_in(one(held["query_id"]), value_set=queries).drop_null().to_numpy()
        restricted[known] = True
        who = pc.index_in(one(pairs[0]), value_set=queries)
        there = pc.is_valid(who)
        values = one(pairs[1]).filter(there).dictionary_encode()
        limits = (restricted, values.dictionary, np.stack([values.indices.to_numpy(zero_copy_only=False).astype(np.int64), who.drop_null().to_numpy().astype(np.int64)]))
    shared = spark.sparkContext.broadcast((queries, sides, limits))
    columns = [("query_id", kind), *([(group, rows.schema[group].dataType)] if apart else []), (index.doc, rows.schema["docs"].dataType.elementType)]
    columns += [(index.carry, rows.schema["carried"].dataType.elementType)] if index.carry else []
    columns.append(("score", T.DoubleType()))
    carry = index.carry

    def allowed(docs: pa.Array) -> np.ndarray:
        """Which of the documents each query may find."""
        restricted, values, (value, who) = shared.value[2]
        out = np.repeat(~restricted[:, None], len(docs), axis=1)
        found = pc.index_in(docs, value_set=values).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(~np.isnan(found.astype(float)))
        if len(places):
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], found[places].astype(np.int64), "left")
            counts = np.searchsorted(value[order], found[places].astype(np.int64), "right") - starts
            out[who[order][ranges(starts, counts)], np.repeat(places, counts)] = True
        return out

    def scored(table: pa.Table, members: pa.Table, side: Side, hits: Hits, table_bonus: pa.Table, table_static: pa.Table, prune: bool) -> None:
        """Add what the rows of a block give."""
        n = len(hits.floor)
        at = pc.index_in(pc.binary_join_element_wise(one(table[group]).cast(pa.string()), one(table["term"]), "\0"), value_set=side.keys)
        table, at = table.filter(pc.is_valid(at)), at.drop_null().to_numpy().astype(np.int64)
        lists = one(table["at"])
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # where the texts of each row's group begin, and which of all texts each posting is of
        texts = one(members["docs"])
        many = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = (np.cumsum(many) - many)[pc.index_in(one(table[group]), value_set=one(members[group])).to_numpy(zero_copy_only=False).astype(np.int64)]
        text = np.repeat(begins, sizes) + lists.flatten().to_numpy(zero_copy_only=False)
        flat = [texts.flatten()]
        if table_bonus.num_rows:
            flat.append(one(table_bonus["docs"]).flatten())
        coded = pa.concat_arrays(flat).dictionary_encode()
        docs, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = len(docs)
        if not size or not (len(text) or table_bonus.num_rows):  # a block without the asked terms
            return
        total_texts = int(many.sum())
        own = code[text]
        carried = None
        if carry:
            last = np.zeros(size, np.int64)
            last[code[:total_texts]] = np.arange(total_texts)
            carried = one(members["carried"]).flatten().take(pa.array(last))
        lens = one(members["lens"]).flatten().to_numpy(zero_copy_only=False)[text]
        values = impact(one(table["tfs"]).flatten().to_numpy(zero_copy_only=False).astype(float), lens.astype(float), np.repeat(side.average[at], sizes))
        static = None
        if factors:
            place = pc.index_in(one(table_static["docs"]).flatten(), value_set=docs)
            there = pc.is_valid(place).to_numpy(zero_copy_only=False)
            static = np.full(size, np.nan)
            static[place.drop_null().to_numpy()] = one(table_static["values"]).flatten().to_numpy(zero_copy_only=False)[there]
        extra = None
        if table_bonus.num_rows:
            who = pc.index_in(one(table_bonus["query_id"]), value_set=shared.value[0])
            many = pc.list_value_length(one(table_bonus["docs"])).to_numpy(zero_copy_only=False).astype(np.int64)
            mine = np.repeat(pc.is_valid(who).to_numpy(zero_copy_only=False), many)
            asker = np.repeat(pc.fill_null(who, -1).to_numpy(zero_copy_only=False).astype(np.int64), many)[mine]
            extra = (asker, code[total_texts:][mine], one(table_bonus["values"]).flatten().to_numpy(zero_copy_only=False)[mine])
        # each row's slots, and what they make of its largest impact
        e_row = np.repeat(np.arange(len(at)), side.sizes[at])
        entry = ranges(side.starts[at], side.sizes[at])
        slots, local = np.unique(side.slot[entry], return_inverse=True)
        weight = side.weight[entry]
        where = np.full(side.slots, -1)
        where[slots] = np.arange(len(slots))
        asker, mine = np.repeat(np.arange(n), side.counts), where[side.of_query]
        asker, mine = asker[mine >= 0], mine[mine >= 0]
        if prune:
            most = np.zeros(len(slots))
            np.maximum.at(most, local.reshape(-1), weight * one(table["top"]).to_numpy()[e_row])
            bound = np.bincount(asker, weights=most[mine], minlength=n).astype(float)  # without weights it counts in integers
            if extra is not None:
                more = np.zeros(n)
                np.maximum.at(more, extra[0], extra[2])
                bound += more
            if static is not None:
                bound *= np.nanmax(static) if not np.isnan(static).all() else 0.0
            active = bound * (1 + 1e-9) + ROOM >= hits.floor
            asker, mine = asker[active[asker]], mine[active[asker]]
        # the elements: a row's documents, for each of its slots
        many = sizes[e_row]
        element = ranges((np.cumsum(sizes) - sizes)[e_row], many)
        e_slot, e_doc, e_value = np.repeat(local.reshape(-1), many), own[element], np.repeat(weight, many) * values[element]
        heads = np.flatnonzero(np.diff(asker, prepend=-1))
        for start in range(0, size, DOCS):
            width = min(DOCS, size - start)
            inside = (e_doc >= start) & (e_doc < start + width) if size > DOCS else slice(None)
            grid = np.zeros((len(slots), width))
            np.maximum.at(grid.reshape(-1), e_slot[inside] * width + e_doc[inside] - start, e_value[inside])
            total = np.zeros((n, width))
            step = max(1, SCORES // width)
            low = 0
            while low < len(heads):  # queries whose slots fit in memory, one at least
                high = max(low + 1, int(np.searchsorted(heads, heads[low] + step, "right")) - 1) if heads[-1] >= heads[low] + step else len(heads)
                end = heads[high] if high < len(heads) else len(mine)
                total[asker[heads[low:high]]] = np.add.reduceat(grid[mine[heads[low] : end]], heads[low:high] - heads[low], axis=0)
                low = high
            if extra is not None:
                in_ = (extra[1] >= start) & (extra[1] < start + width)
                np.add.at(total, (extra[0][in_], extra[1][in_] - start), extra[2][in_])
            found = total > 0
            if static is not None:
                total *= static[start : start + width]
                found &= ~np.isnan(static[start : start + width])
            if shared.value[2] is not None:
                found &= allowed((carried if carry else docs).slice(start, width))
            q, d = np.nonzero(found & (total >= hits.floor[:, None]))
            if len(q):
                hits.add(q, total[q, d], docs.take(pa.array(d + start)), carried.take(pa.array(d + start)) if carry else None)
            if hits.k is not None and hits.size > hits.limit:
                hits.cut()

    def out(hits: Hits, name: object) -> Iterator[pa.RecordBatch]:
        table = hits.cut()
        hits.parts, hits.size = [], 0
        if table is not None and table.num_rows:
            parts = [shared.value[0].take(one(table["query"])), *([pa.array([name] * table.num_rows)] if apart else []), one(table["doc"])]
            parts += [one(table["carried"])] if carry else []
            yield pa.RecordBatch.from_arrays([*parts, one(table["score"])], names=[c for c, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sides, _ = shared.value
        found = {name: Hits(len(asked), k) for name in sides}
        done = 0

        def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal done
            terms, others = table.filter(pc.is_valid(table["term"])), table.filter(pc.is_null(table["term"]))
            texts, others = others.filter(pc.is_valid(others["lens"])), others.filter(pc.is_null(others["lens"]))
            bonus, static = others.filter(pc.is_valid(others["query_id"])), others.filter(pc.is_null(others["query_id"]))
            for name, side in sides.items():
                part, own = (t.filter(pc.equal(t[group], pa.scalar(name, t[group].type))) if apart else t for t in (terms, texts))
                scored(part, own, side, found[name], bonus, static, k is not None and done >= probe)
                if k is None and found[name].size > HELD:
                    yield from out(found[name], name)
                elif done < probe:
                    found[name].cut()
            done += 1

        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            numbers = one(table["block"]).to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if held and start < end and held[-1]["block"][0].as_py() != numbers[start]:
                    yield from block(pa.concat_tables(held))
                    held = []
                if start < end:
                    held.append(table.slice(start, end - start))
        if held:
            yield from block(pa.concat_tables(held))
        for name, hits in found.items():
            yield from out(hits, name)

    schema = T.StructType([T.StructField(*c) for c in columns])
    if not isinstance(rows, Scan):
        return rows.mapInArrow(run, schema)
    scan = rows.run
    return rows.texts.mapInArrow(lambda batches: run(scan(batches)), schema)
