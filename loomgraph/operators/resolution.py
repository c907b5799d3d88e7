"""Entity resolution: which records of all documents are the same entity.

Records come in order. One that shares its id with an earlier leader, or its type and nearly its name, follows that
leader; any other is a leader itself. A record is compared with leaders alone, so this is no connected component: it
is the first maximal independent set in record order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.properties import merged
from ..functions.similarity import Names, keyed, scored
from ..functions.text import SAME_NAME, token_sort
from .iteration import checkpoint, numbered

#: Types whose records differ by numbers in their names; strict resolution compares these not by name.
NUMBERED = ("MetricValue", "Period")


def with_names(entities: DataFrame) -> DataFrame:
    """Adds name: the property, or the id where there is none."""
    name = F.expr("try_variant_get(try_element_at(properties, 'name'), '$', 'string')")
    return entities.withColumn("name", F.coalesce(name, F.col("id")))


def name_index(names: DataFrame, least: int = SAME_NAME) -> DataFrame:
    """(type, name, size, prefix): names(type, name), token-sorted, lower-case and distinct, with their length and that of
    what all names of their type begin with, which adds to any common subsequence."""
    ends = names.groupBy("type").agg(F.min("name").alias("low"), F.max("name").alias("high"))
    some = F.least(F.length("low"), F.length("high"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(some, F.lit(1))), lambda i: (i <= some) & (F.substring("low", F.lit(1), i) == F.substring("high", F.lit(1), i)))
    return names.join(F.broadcast(ends.select("type", F.size(same).alias("prefix"))), "type").select("type", "name", F.length("name").alias("size"), "prefix")


#: Keys of names that are sent to all tasks; more of them are joined by a shuffle.
SENT = 1 << 19


def similar(left: DataFrame, right: DataFrame | None = None, least: int = SAME_NAME) -> DataFrame:
    """(type, a, b, score) of names of one index with others of the same index, of one type and with at least that score;
    without the others, of pairs a < b of the names themselves. A pair may come more than once.

    Candidates have a key in common (functions.similarity.keys), so that of many names that are nearly all alike only
    those meet that are similar. The names on the right have more keys; let them be the few.
    """
    sizes = lambda df: df.groupBy("type").agg(F.sort_array(F.collect_set("size")).alias("sizes"))
    others = left if right is None else right
    a = keyed(left.join(F.broadcast(sizes(others)), "type"), least, True, right is None).withColumnRenamed("name", "a")
    b = checkpoint(keyed(others.join(F.broadcast(sizes(left)), "type"), least, False, right is None).withColumnRenamed("name", "b"))
    few = b.limit(SENT + 1).count() <= SENT
    met = a.join(F.broadcast(b) if few else b, ["type", "key"])
    if right is None:
        ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        met = met.filter(F.col("a") != F.col("b")).select("type", *ends)
    return scored(met if few else met.select("type", "a", "b").distinct(), least)


def similar_names(names: DataFrame, least: int = SAME_NAME) -> DataFrame:
    """(type, a, b, score), a < b, of all pairs of names(type, name) of one type with at least that score; name is
    token-sorted, lower-case and distinct. Names that are nearly all alike have as many pairs as their square; leaders()
    and assign() never ask for these."""
    index = checkpoint(name_index(names, least))
    return similar(index, least=least).distinct()


def _dense(names: DataFrame, least: int, most: int) -> bool:
    """Whether names of an index have more than `most` candidates each."""
    own = keyed(names.join(F.broadcast(names.groupBy("type").agg(F.sort_array(F.collect_set("size")).alias("sizes"))), "type"), least, True, True)
    met = own.groupBy("type", "key").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first().pairs
    return (met or 0) > most * names.count()


def _both_ways(near: DataFrame) -> DataFrame:
    return near.select("type", "a", "b").unionByName(near.select("type", F.col("b").alias("a"), F.col("a").alias("b")))


def fold(keys: list[tuple[str, str, str]], least: int, by_id: tuple[str, ...]) -> list[bool]:
    """Which of keys (id, type, sorted_name) lead, one after another in order; names of the types `by_id` do not count."""
    ids: dict[str, list[int]] = {}
    types: dict[str, list[int]] = {}
    for i, (key, kind, _) in enumerate(keys):
        ids.setdefault(key, []).append(i)
        types.setdefault(kind, []).append(i)
    names = Names([name for _, _, name in keys])
    decided, leads = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for i, (key, kind, name) in enumerate(keys):
        if decided[i]:
            continue
        leads[i] = True
        decided[ids[key]] = True
        if kind not in by_id:
            own = np.array(types[kind])
            later = own[(own > i) & ~decided[own]]
            decided[later[names.scores(name, later) >= least]] = True
    return leads.tolist()


def _folded(keys: DataFrame, least: int, strict: bool) -> DataFrame:
    """Those of LOCAL keys at most that lead, in one task."""
    by_id = NUMBERED if strict else ()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = list(batches)
        if not every:
            return
        rows = pd.concat(every).sort_values("seq")
        yield rows[fold(list(zip(rows["id"], rows["type"], rows["sorted_name"])), least, by_id)]

    return keys.select("id", "type", "sorted_name", "seq").coalesce(1).mapInPandas(run, keys.select("id", "type", "sorted_name", "seq").schema)


def _first_set(keys: DataFrame, index: DataFrame, least: int, strict: bool, local: int) -> DataFrame:
    """Those of keys(id, type, sorted_name, seq) that lead, if there are no others.

    `local` keys are decided in one task. More of them decide in rounds, each as soon as all earlier ones with its id or
    nearly its name have decided, until so few are left; these have no leader yet, so they decide among themselves.
    Names with many similar ones are taken in parts again instead, as a few leaders decide most of them.
    """
    count = keys.count()
    if count <= local:
        return _folded(keys, least, strict) if count else keys
    own = checkpoint(index.join(keys.select("type", F.col("sorted_name").alias("name")).distinct(), ["type", "name"], "left_semi"))
    if _dense(own, least, DENSE):
        return _leading(keys, index, least, strict, local, local)
    same = own.select("type", F.col("name").alias("a"), F.col("name").alias("b"))
    near = checkpoint(_both_ways(similar(own, least=least)).unionByName(same))
    # The records of one name, or of one id, have one leader at most, as all later ones follow it. So what a record
    # must know of them is their leader and the first one that is not decided: two numbers, however many they are.
    first = lambda when, name: F.min(F.when(when, F.col("seq"))).alias(name)
    state = keys.withColumn("leads", F.lit(None).cast("boolean"))
    open_ = count
    while open_ > local:
        by_id = state.groupBy("id").agg(first(F.col("leads"), "id_lead"), first(F.col("leads").isNull(), "id_wait"))
        named = state.groupBy("type", F.col("sorted_name").alias("b")).agg(first(F.col("leads"), "lead"), first(F.col("leads").isNull(), "wait"))
        around = near.join(named, ["type", "b"]).groupBy("type", F.col("a").alias("sorted_name")).agg(F.min("lead").alias("lead"), F.min("wait").alias("wait"))
        earlier = lambda c: F.coalesce(F.col(c) < F.col("seq"), F.lit(False))
        follows, waits = earlier("id_lead") | earlier("lead"), earlier("id_wait") | earlier("wait")
        decided = F.when(F.col("leads").isNotNull(), F.col("leads")).when(follows, False).when(~waits, True)
        state = checkpoint(state.join(by_id, "id").join(around, ["type", "sorted_name"], "left").select(*keys.columns, decided.alias("leads")))
        open_ = state.filter("leads IS NULL").count()
    done = state.filter("leads").drop("leads")
    if not open_:
        return done
    # Some that are open may follow a leader of the last round.
    led = state.filter("leads")
    ids = led.groupBy("id").agg(F.min("seq").alias("id_lead"))
    around = near.join(led.groupBy("type", F.col("sorted_name").alias("b")).agg(F.min("seq").alias("lead")), ["type", "b"]).groupBy("type", F.col("a").alias("sorted_name")).agg(F.min("lead").alias("lead"))
    rest = state.filter("leads IS NULL").join(ids, "id", "left").join(around, ["type", "sorted_name"], "left").filter("coalesce(id_lead > seq, true) AND coalesce(lead > seq, true)")
    return done.unionByName(_folded(rest, least, strict))


def _keys(records: DataFrame, least: int, strict: bool, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct (id, type, sorted_name) of records, with the first seq of each, and the index of their names and of
    those of known leaders."""
    keyed = records.withColumn("sorted_name", token_sort(F.col("name")))
    keys = checkpoint(keyed.groupBy("id", "type", "sorted_name").agg(F.min("seq").alias("seq")))
    every = keys if known is None else keys.select("type", "sorted_name").unionByName(known.select("type", "sorted_name"))
    by_name = every.filter(~F.col("type").isin(*NUMBERED)) if strict else every
    return keys, checkpoint(name_index(by_name.select("type", F.col("sorted_name").alias("name")).distinct(), least))


def _leading(keys: DataFrame, index: DataFrame, least: int, strict: bool, first: int, local: int, known: DataFrame | None = None) -> DataFrame:
    """Those of keys that lead, after the known leaders.

    Keys are taken in order, in parts each three times as long as all before it. A part is compared with the leaders before it, and
    what is left of it with itself. So names that are nearly all alike, which soon have all their leaders, never meet
    each other, and there are about as many parts as the number of keys has decimal digits, or fewer than twice that.
    """
    placed = checkpoint(keys.join(numbered(keys, "seq", "place"), "seq"))
    total, begin, end, found = placed.count(), 0, first, known
    while begin < total:
        part = placed.filter((F.col("place") >= begin) & (F.col("place") < end)).drop("place")
        if found is not None:
            part = part.join(found.select("id").distinct(), "id", "left_anti")
            named = lambda df: df.select("type", F.col("sorted_name").alias("name")).distinct()
            led = index.join(named(found), ["type", "name"], "left_semi")
            part = checkpoint(part)
            if part.isEmpty():
                begin, end = end, 4 * end
                continue
            own = index.join(named(part), ["type", "name"], "left_semi")
            near = similar(own, led, least).select("type", F.col("a").alias("sorted_name")).unionByName(led.select("type", F.col("name").alias("sorted_name"))).distinct()
            part = part.join(near, ["type", "sorted_name"], "left_anti").select(*keys.columns)
        new = _first_set(checkpoint(part), index, least, strict, local)
        found = checkpoint(new if found is None else found.unionByName(new))
        begin, end = end, 4 * end
    return keys.limit(0) if found is None else found


#: Keys of the first part, the most that one task decides, and candidates of a name from which parts are taken anew.
FIRST, LOCAL, DENSE = 1024, 2048, 64


def leaders(records: DataFrame, least: int = SAME_NAME, strict: bool = False, first: int = FIRST, local: int = LOCAL) -> DataFrame:
    """(id, type, sorted_name, seq, is_leader) of the distinct keys of records(id, type, name, seq).

    A record's decision depends on its id, type and name alone, and is that of the first record with the same ones.
    strict: types of numbered names are compared by id only.
    """
    keys, index = _keys(records, least, strict)
    lead = _leading(keys, index, least, strict, first, local).select("id", "type", "sorted_name", F.lit(True).alias("is_leader"))
    return keys.join(lead, ["id", "type", "sorted_name"], "left").withColumn("is_leader", F.coalesce("is_leader", F.lit(False))).select("id", "type", "sorted_name", "seq", "is_leader")


def assign(records: DataFrame, least: int = SAME_NAME, strict: bool = False, first: int = FIRST, local: int = LOCAL, known: DataFrame | None = None) -> DataFrame:
    """records with canonical_id: an earlier leader of the same id comes first, then the earliest leader of nearly
    the same name, else the record's own. known: leaders(id, type, name, seq) of records that come before all these."""
    if known is not None:
        known = checkpoint(known.select("id", "type", token_sort(F.col("name")).alias("sorted_name"), "seq"))
    keys, index = _keys(records, least, strict, known)
    lead = checkpoint(_leading(keys, index, least, strict, first, local, known))
    keyed = records.withColumn("sorted_name", token_sort(F.col("name")))
    same = lead.groupBy("id").agg(F.min("seq").alias("own_since"))
    led = index.join(lead.select("type", F.col("sorted_name").alias("name")).distinct(), ["type", "name"], "left_semi")
    # Keys whose id has a leader no later than their first record never ask for that of their name.
    asking = keys.join(same, "id", "left").filter("coalesce(own_since > seq, true)")
    own = index.join(asking.select("type", F.col("sorted_name").alias("name")).distinct(), ["type", "name"], "left_semi")
    both = similar(own, led, least).select("type", "a", "b")
    # The earliest similar leader of a name is that of all its records that come after it.
    near = both.join(lead.select("type", F.col("sorted_name").alias("b"), F.col("id").alias("leader"), F.col("seq").alias("since")), ["type", "b"])
    best = near.groupBy("type", F.col("a").alias("sorted_name")).agg(F.min("since").alias("since"), F.min_by("leader", "since").alias("leader"))
    joined = keyed.join(same, "id", "left").join(best, ["type", "sorted_name"], "left")
    canonical = F.when(F.col("own_since") <= F.col("seq"), F.col("id")).when(F.col("since") <= F.col("seq"), F.col("leader")).otherwise(F.col("id"))
    return joined.withColumn("canonical_id", canonical).drop("own_since", "since", "leader", "sorted_name")


def alias(assigned: DataFrame) -> DataFrame:
    """(document_id, doc_ord, raw_id, canonical_id): a document's last decision on each of its ids."""
    return assigned.groupBy("document_id", "doc_ord", F.col("id").alias("raw_id")).agg(F.max_by("canonical_id", "seq").alias("canonical_id"))


def resolved(assigned: DataFrame) -> DataFrame:
    """One row for each canonical id: type, name and place of its first record, properties last-wins, sources in
    order without repetition."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"])
    first = assigned.groupBy("canonical_id").agg(
        F.min_by("type", "seq").alias("entity_type"),
        F.min_by("name", "seq").alias("name"),
        F.min("doc_ord").alias("first_doc_ord"),
        F.array_distinct(in_order).alias("sources"),
    )
    return first.join(merged(assigned, ["canonical_id"]), "canonical_id", "left").withColumnRenamed("canonical_id", "entity_id")


def remapped_count(aliases: DataFrame) -> DataFrame:
    """(document_id, remapped): how many ids of a document stand for another one."""
    return aliases.groupBy("document_id").agg(F.count_if(F.col("raw_id") != F.col("canonical_id")).alias("remapped"))
