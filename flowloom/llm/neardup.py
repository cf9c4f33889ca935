"""Linking of texts whose word-shingle sets are similar: sketch, band, verify on full sets, join into components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch, gives_back, of_ids
from flowloom.llm.components import components
from flowloom.llm.sketch import band_keys, shingle_sets, sketches


#: Counters of shingles by which a crowd's shingles are ordered: 8 MB.
COUNTERS = 1 << 20


@dataclass(frozen=True)
class Similarity:
    """Texts are linked when 100 * |A and B| >= percent * |A or B| for their sets of `width`-word shingles.

    coordinates / rows bands: at a similarity of 0.75, 32 bands of 4 miss a pair with
    a probability of 5e-6. The second sketch's 128 bands of 8 must agree in met_2
    bands at least, which misses such a pair with 2e-5 (13 bands are expected, at 0.5
    half a band). Buckets of at most `small` texts have all their pairs looked at;
    larger ones go through an exact prefix filter, so no bucket is capped.
    """

    width: int = 5
    percent: int = 75
    coordinates: int = 128
    rows: int = 4
    coordinates_2: int = 1024
    rows_2: int = 8
    met_2: int = 2
    small: int = 32


def sketched(units: DataFrame, how: Similarity) -> DataFrame:
    """units (id long, text string) to (id, n, fp, bands): set size, set fingerprint (null if empty), band keys."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in (b.iloc[at : at + 500] for b in batches for at in range(0, len(b), 500)):
            sets = shingle_sets(x["text"].tolist(), how.width)
            keys = band_keys(sketches(sets, how.coordinates), how.rows)
            fp = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            yield pd.DataFrame({
                "id": x["id"].array, "n": np.array([len(s) for s in sets], np.int64), "fp": pd.array(fp, "Int64"),
                "bands": [k if len(s) else None for k, s in zip(keys, sets, strict=True)],
            })

    return units.select("id", "text").mapInPandas(work, "id long, n long, fp long, bands array<long>")


def sets_of_texts(units: DataFrame, how: Similarity) -> Callable[[DataFrame], DataFrame]:
    """Gives the full sets (id, hashes) of the units (id, text) in a written table of distinct ids."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 500):
                part = x.iloc[at : at + 500]
                yield pd.DataFrame({"id": part["id"], "hashes": [s.view(np.int64) for s in shingle_sets(part["text"].tolist(), how.width)]})

    def sets(ids: DataFrame) -> DataFrame:
        some = of_ids(units.select("id", "text"), ids, "id")
        # rows that share an id count once
        return some.mapInPandas(work, "id long, hashes array<long>").groupBy("id").agg(F.any_value("hashes").alias("hashes"))

    return sets


def _verified(pairs: DataFrame, sets: DataFrame, how: Similarity, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    alike = F.lit(100) * both >= F.lit(how.percent) * (F.size("ha") + F.size("hb") - both)
    # nothing is aggregated behind the joins, so Spark can split the partition of a head that many meet
    return scratch.save(pairs.join(right, "b").join(left, "a").where(alike).select("a", "b"))


def _rebanded(sets: DataFrame, how: Similarity) -> DataFrame:
    """(id, n, keys) with the band keys of a second, larger sketch of sets (id, n, hashes)."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 500):
                part = x.iloc[at : at + 500]
                keys = band_keys(sketches([h.view(np.uint64) for h in part["hashes"]], how.coordinates_2, seed=2), how.rows_2)
                yield pd.DataFrame({"id": part["id"], "n": part["n"], "keys": pd.Series(list(keys), part.index, dtype=object)})

    return sets.select("id", "n", "hashes").mapInPandas(work, "id long, n long, keys array<long>")


def _could(how: Similarity, a: str = "na", b: str = "nb"):
    """The sizes of two sets alone don't rule out that they are similar enough."""
    return F.lit(100) * F.least(a, b) >= F.lit(how.percent) * F.greatest(a, b)


def linked(units: DataFrame, scratch: Scratch, how: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """Group the units (id long, text string) that similarity links, directly or in a chain.

    Returns (sized, grouped): sized has (id, n, fp) for every unit, grouped has
    (fp, n, rep, component) for every distinct set: rep is the smallest id with
    that set, component the smallest id that links reach from it. Empty sets have
    a null fp and stand in sized alone. Units without an id are in neither group.

    1. Equal sets fall together by fingerprint and size.
    2. Each set is joined to the smallest id of one of its buckets, the one it
       meets in most bands, and the pair verified: this gathers large groups of
       copies with one test a member.
    3. Sets in buckets that still hold more than one component are banded again by
       a larger sketch with longer bands, which parts texts that only share a
       passage. Its large buckets are gathered in rounds: one member after the
       other, drawn by its hash, is held against those of other components, as
       long as that links enough of them. Pairs between the components that are
       left are verified: all of them in small buckets, and in large ones those
       that share a rare shingle (see _rare_pairs). Within one component a further
       link changes nothing.
    """
    sk = scratch.save(sketched(units, how))
    sets = scratch.save(
        sk.where("fp is not null and id is not null").groupBy("fp", "n").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    )
    final = link_keyed(sets.select(F.col("rep").alias("id"), "n", F.col("bands").alias("keys")), sets_of_texts(units, how), scratch, how)
    grouped = scratch.save(
        sets.select("fp", "n", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", "rep", F.coalesce("component", "rep").alias("component"))
    )
    sized = scratch.save(sk.select("id", "n", "fp"))
    scratch.drop(sk, sets)
    return sized, grouped


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows (id, ...) with the component that label (node, component) has for them, themselves where it has none."""
    joined = rows.join(label.withColumnRenamed("node", "id"), "id", "left")
    return joined.withColumn("component", F.coalesce("component", "id"))


def met_in(keys: np.ndarray, ids: np.ndarray, ns: np.ndarray) -> pd.DataFrame:
    """(key, id, n, held, head, head_n) of the ids whose key another one has too: held is their number, head the least. Repeated rows count once."""
    order = np.argsort(keys)
    by = keys[order]
    same = by[1:] == by[:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(by) else order
    keys, ids, ns = keys[order], ids[order], ns[order]
    by = np.lexsort((ids, keys))
    keys, ids, ns = keys[by], ids[by], ns[by]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, ns = keys[new], ids[new], ns[new]
    heads = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    held = np.diff(np.append(heads, len(keys)))
    out = pd.DataFrame({"key": keys, "id": ids, "n": ns, "held": np.repeat(held, held), "head": np.repeat(ids[heads], held), "head_n": np.repeat(ns[heads], held)})
    return out[out["held"] > 1]


def _buckets(sets: DataFrame, columns: str) -> DataFrame:
    """The columns of met_in for the sets (id, n, keys), of which rows may repeat.

    A batch's keys go to their partitions as a few arrays of numbers: most keys have one set only, and
    a row for each would cost more than all that is done with those that meet.
    """
    parts = 4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @gives_back
    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            key = np.concatenate(x["keys"].tolist())
            many = [len(k) for k in x["keys"]]
            part = (key.view(np.uint64) >> np.uint64(32)) % np.uint64(parts)
            by = np.argsort(part)
            cuts = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            columns = {"keys": key[by], **{f"{c}s": np.repeat(x[c].to_numpy(np.int64), many)[by] for c in ("id", "n")}}
            bounds = list(zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True))
            yield pd.DataFrame({"part": some, **{c: [v[a:b].tobytes() for a, b in bounds] for c, v in columns.items()}})

    @gives_back
    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for x in batches:
            # a partition's rows are in the order of their parts, and a part may go on in the next batch
            last = x["part"].to_numpy() == x["part"].iloc[-1]
            if held and held[-1]["part"].iloc[-1] != x["part"].iloc[-1]:
                yield found([*held, x[~last]])
                held = []
            elif not held and not last.all():
                yield found([x[~last]])
            held.append(x[last])
        if held:
            yield found(held)

    def found(rows: list[pd.DataFrame]) -> pd.DataFrame:
        return met_in(*(np.frombuffer(b"".join(d for r in rows for d in r[c]), np.int64) for c in ("keys", "ids", "ns")))[names]

    names = columns.split(", ")
    sent = sets.select("id", "n", "keys").mapInPandas(dealt, "part int, keys binary, ids binary, ns binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInPandas(met, ", ".join(f"{c} long" for c in names))


def link_keyed(keyed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], scratch: Scratch, how: Similarity) -> DataFrame:
    """Steps 2 and 3 of linked: (node, component) for the sets that links join.

    keyed has (id, n, keys) with the band keys of each set, and may repeat rows; sets_of
    gives the full sets (id, hashes) of the ids in a table.
    """
    in_bucket = scratch.save(_buckets(keyed, "key, id, n, head, head_n"))
    met = in_bucket.where("id <> head").where(_could(how, "n", "head_n")).groupBy("id", "head").agg(F.count("*").alias("met"))
    first = scratch.save(met.groupBy("id").agg(F.max(F.struct("met", (-F.col("head")).alias("low"))).alias("top")).select((-F.col("top.low")).alias("a"), F.col("id").alias("b")))
    full = scratch.save(sets_of(scratch.save(in_bucket.select("id").distinct())))
    good = _verified(first, full, how, scratch)
    scratch.drop(first)
    label = components(good, scratch)

    labelled = scratch.save(_labelled(in_bucket.select("key", "id", "n"), label))
    again = scratch.save(labelled.join(_mixed(labelled).select("key"), "key").select("id", "n").distinct())
    scratch.drop(in_bucket, labelled)
    if again.isEmpty():
        return label
    full_again = scratch.save(full.join(again, "id"))
    scratch.drop(full, again)
    banded = scratch.save(_buckets(_rebanded(full_again, how), "key, id, n, held"))
    good, label = _gathered(banded.where(F.col("held") > how.small).drop("held"), full_again, good, label, how, scratch)
    in_bucket = scratch.save(_labelled(banded.drop("held"), label))
    scratch.drop(banded)
    mixed = scratch.save(_mixed(in_bucket))
    open_ = scratch.save(in_bucket.join(mixed, "key"))
    scratch.drop(in_bucket, mixed)
    side = lambda x: open_.where(F.col("held") <= how.small).select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"))
    pairs = side("a").join(side("b"), "key").where("a < b and ca <> cb").where(_could(how)).groupBy("a", "b").agg(F.count("*").alias("met"))
    pairs = pairs.where(F.col("met") >= how.met_2).select("a", "b")
    crowd = open_.where(F.col("held") > how.small).select("id", "component").distinct()
    crowd = scratch.save(full_again.join(crowd, "id"))
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_rare_pairs(crowd, how, scratch)).distinct()
    pairs = scratch.save(pairs)
    more = _verified(pairs, full_again, how, scratch)
    final = label if more.isEmpty() else components(good.unionByName(more), scratch)
    scratch.drop(more, pairs, full_again, open_, crowd)
    return final


def _gathered(banded: DataFrame, sets: DataFrame, good: DataFrame, label: DataFrame, how: Similarity, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The links and components with those that single members of large mixed buckets bring.

    Each round a bucket holds one member, drawn by a hash of round and id, against its
    members in other components: as many tests as members, where all pairs would be
    their square. Rounds end when fewer than one test in twenty links.
    """
    turn = 0
    while True:
        now = scratch.save(_labelled(banded, label))
        mixed = _mixed(now).where(F.col("held") > how.small)
        drawn = F.min_by(F.struct("id", "n", "component"), F.xxhash64(F.lit(turn), "id")).alias("one")
        heads = now.groupBy("key").agg(drawn).join(mixed.select("key"), "key").select("key", "one.id", "one.n", "one.component").toDF("key", "a", "na", "ca")
        pairs = now.withColumnsRenamed({"id": "b", "n": "nb", "component": "cb"}).join(heads, "key").where("ca <> cb").where(_could(how))
        pairs = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        tests = pairs.count()
        if not tests:
            return good, label
        more = _verified(pairs, sets, how, scratch)
        links = more.count()
        if links:
            good = scratch.save(good.unionByName(more))
            label = components(good, scratch)
        scratch.drop(now, pairs, more)
        if links * 20 <= tests:
            return good, label
        turn += 1


def _mixed(in_bucket: DataFrame) -> DataFrame:
    """(key, held) of the buckets that hold more than one component."""
    stats = in_bucket.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held"))
    return stats.where("lo < hi").select("key", "held")


def _counted(crowd: DataFrame) -> np.ndarray:
    """How many shingles of crowd's hashes fall in each of COUNTERS counters: what comes to the driver has a fixed size."""

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = np.zeros(COUNTERS, np.int64)
        for x in batches:
            for h in x["hashes"]:
                np.add.at(often, h & (COUNTERS - 1), 1)
        at = np.flatnonzero(often)
        yield pd.DataFrame({"counter": at, "often": often[at]})

    out = np.zeros(COUNTERS, np.int64)
    found = crowd.select("hashes").mapInPandas(work, "counter long, often long").groupBy("counter").agg(F.sum("often").alias("often")).toPandas()
    out[found["counter"].to_numpy()] = found["often"].to_numpy()
    return out


def _rare_pairs(crowd: DataFrame, how: Similarity, scratch: Scratch) -> DataFrame:
    """Pairs (a < b) between components of crowd (id, n, component, hashes) that share one of their rarest shingles.

    Prefix filter: with the shingles of every set in one order, two sets that are
    similar enough share one of the first n - ceil(percent * n / 100) + 1. Any order
    serves; going by counters that shingles share, from the rarest on, leaves out
    what a crowd has in common. What comes after the first shared shingle bounds the
    overlap, which rules out most pairs that share one passage (positional filter).
    Shingles seen in one component only are dropped, and for the others the members
    outside the shingle's most frequent component are joined with all its members.
    """
    often = crowd.sparkSession.sparkContext.broadcast(_counted(crowd))
    percent = how.percent

    @gives_back
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 500):
                part, first = x.iloc[at : at + 500], []
                for h in part["hashes"]:
                    keep = len(h) - -(-percent * len(h) // 100) + 1
                    first.append(h[np.lexsort((h, often.value[h & (COUNTERS - 1)]))[:keep]])
                sizes = [len(f) for f in first]
                place = np.concatenate([np.arange(n) for n in sizes])
                repeated = {c: np.repeat(part[c].to_numpy(np.int64), sizes) for c in ("id", "component", "n")}
                yield pd.DataFrame({**repeated, "rest": repeated["n"] - place, "shingle": np.concatenate(first)})

    prefix = crowd.select("id", "component", "n", "hashes").mapInPandas(work, "id long, component long, n long, rest long, shingle long")
    prefix = scratch.save(prefix)
    held = prefix.groupBy("shingle", "component").agg(F.count("*").alias("held")).groupBy("shingle")
    hub = scratch.save(held.agg(F.max_by("component", F.struct("held", "component")).alias("hub"), F.count("*").alias("kinds")).where("kinds > 1").select("shingle", "hub"))
    mixed = scratch.save(prefix.join(hub, "shingle"))
    side = lambda x: [F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("rest").alias(f"r{x}"), F.col("component").alias(f"c{x}")]
    out, other = mixed.where("component <> hub").select("shingle", *side("a")), mixed.select("shingle", *side("b"))
    enough = F.lit(100 + how.percent) * F.least("ra", "rb") >= F.lit(how.percent) * (F.col("na") + F.col("nb"))
    found = out.join(other, "shingle").where("ca <> cb").where(_could(how)).where(enough)
    found = scratch.save(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.drop(prefix, hub, mixed)
    return found
