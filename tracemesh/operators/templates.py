"""Message templates from structured logs: dictionary encoding and pair rules.

Records are ``(rec, json)`` with ``rec`` in input order.  A vector alternates the tokens of
keys and values, keys sorted without regard to case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemesh.operators.order import join_counted, join_lookup, number_rows
from tracemesh.session import discard, materialise

# --- fixed values -----------------------------------------------------------
BASE_TOKEN = 1000
TIME_TOKEN = 1
ANY_TOKEN = 0
TIME_TEXT = '"timestamp"'

#: Chains are looked for in rounds in which fewer than one in so many open vectors go ahead by themselves.
CHAIN_SHARE = 8


def mutable_token(text: Column) -> Column:
    """Whether a string is a time of its own: it starts with 2025, or is ten long and starts with 1."""
    return text.startswith("2025") | (text.startswith("1") & (F.length(text) == 10))


def items(records: DataFrame) -> DataFrame:
    """``(rec, idx, text, mutable)``: keys at even and values at odd places.

    ``text`` is the JSON text of the item in lower case, so that the number 1 and the string
    "1" stay apart; a nested value is one item.
    """
    fields = F.map_entries(F.from_json("json", "map<string,variant>"))
    keyed = F.transform(fields, lambda e, i: F.struct(F.lower(e["key"]).alias("fold"), i.alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    # Variants cannot be compared, so the sort key carries the place in the list instead.
    order = F.array_sort(F.transform(keyed, lambda e: F.struct(e["fold"], e["n"])))
    placed = records.select("rec", keyed.alias("_f"), order.alias("_o"))
    rows = placed.select("rec", "_f", F.posexplode("_o").alias("_i", "_s")).select(
        "rec", "_i", F.element_at("_f", F.col("_s.n") + 1).alias("e")
    )
    is_text = F.schema_of_variant("e.v") == "STRING"
    value = F.struct(
        (F.col("_i") * 2 + 1).alias("idx"),
        F.lower(F.to_json("e.v")).alias("text"),
        (is_text & mutable_token(F.when(is_text, F.col("e.v").cast("string")))).alias("mutable"),
    )
    key = F.struct((F.col("_i") * 2).alias("idx"), F.lower(_quoted(F.col("e.k"))).alias("text"), mutable_token(F.col("e.k")).alias("mutable"))
    return rows.select("rec", F.explode(F.array(key, value)).alias("x")).select(
        "rec", "x.idx", "x.text", F.coalesce("x.mutable", F.lit(False)).alias("mutable")
    )


def _quoted(text: Column) -> Column:
    """A key as JSON text."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def build_dictionary(records: DataFrame, base: int = BASE_TOKEN, existing: DataFrame | None = None) -> DataFrame:
    """``(token_text, token, cnt)``: tokens above ``base`` in order of first use, after those of ``existing``."""
    return _numbered(items(records), base, existing)


def _numbered(found: DataFrame, base: int, existing: DataFrame | None = None) -> DataFrame:
    """The dictionary of ``items``."""
    used = found.filter("not mutable").groupBy(F.col("text").alias("token_text")).agg(
        F.min(F.struct("rec", "idx")).alias("_first"), F.count(F.lit(1)).alias("cnt")
    )
    start = F.lit(base).cast("bigint")
    new = used
    if existing is not None:
        new = used.join(existing.select("token_text"), "token_text", "left_anti")
        start = existing.agg(F.coalesce(F.max("token"), F.lit(base)).cast("bigint").alias("m")).scalar()
    new = number_rows(new.select("token_text", "cnt", "_first.*"), ["rec", "idx"], "token")
    new = new.select("token_text", (F.col("token") + start).alias("token"), "cnt")
    if existing is None:
        return new
    again = existing.select("token_text", "token").join(used.select("token_text", "cnt"), "token_text", "left")
    return again.select("token_text", "token", F.coalesce("cnt", F.lit(0)).alias("cnt")).unionByName(new)


def tokenise(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(vec_id, vec)`` per record.  Keys that are in every record are looked up by broadcast."""
    return _vectors(materialise(items(records), "items"), dictionary)  # three uses, one parse


def encode(records: DataFrame, base: int = BASE_TOKEN) -> tuple[DataFrame, DataFrame]:
    """The vectors of the records and the dictionary built from them, both written, with one parse for both."""
    found = materialise(items(records), "items")
    dictionary = materialise(_numbered(found, base), "dictionary")
    vectors = materialise(_vectors(found, dictionary), "vectors")
    discard(found)
    return vectors, dictionary


def _vectors(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The vectors of written ``items``."""
    fixed = found.filter("mutable").select("rec", "idx", F.lit(TIME_TOKEN).cast("bigint").alias("token"))
    looked_up = join_counted(
        found.filter("not mutable").select("rec", "idx", "text"), dictionary.withColumnRenamed("token_text", "text"), "text", "cnt"
    )
    placed = looked_up.select("rec", "idx", "token").unionByName(fixed)
    vec = F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"])
    return placed.groupBy("rec").agg(vec.alias("vec")).withColumnRenamed("rec", "vec_id")


def detokenise(vectors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(vec_id, field, key, value)``: the items of each vector back as (lower-cased) JSON text."""
    rows = materialise(vectors.select("vec_id", F.posexplode("vec").alias("idx", "token")), "cells")
    texts = dictionary.select("token", "token_text", "cnt")
    known = join_counted(rows.filter(F.col("token") != TIME_TOKEN), texts, "token", "cnt").select("vec_id", "idx", "token_text")
    times = rows.filter(F.col("token") == TIME_TOKEN).select("vec_id", "idx", F.lit(TIME_TEXT).alias("token_text"))
    both = known.unionByName(times).withColumn("field", F.floor(F.col("idx") / 2).cast("bigint"))
    return both.groupBy("vec_id", "field").agg(
        F.max(F.when(F.col("idx") % 2 == 0, F.col("token_text"))).alias("key"),
        F.max(F.when(F.col("idx") % 2 == 1, F.col("token_text"))).alias("value"),
    )


def vector_lengths(vectors: DataFrame) -> DataFrame:
    """Vectors per length, most common first."""
    return vectors.groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "length")


def _distinct(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("vec").agg(F.min("vec_id").alias("i"), F.count(F.lit(1)).alias("cnt"))


def _buckets(distinct: DataFrame) -> DataFrame:
    """Each vector once per pair of places, under a 128-bit hash of what stands in the other places.

    The hash of a vector is the exclusive or of a hash per place, so leaving out two places takes two
    more of them.  Two vectors of one length differ in at most the places (p, q) if they meet in that
    bucket.  Places where all vectors of a length agree are left out.
    """
    cells = distinct.select(F.size("vec").alias("n"), F.posexplode("vec").alias("p", "t"))
    varying = cells.groupBy("n", "p").agg((F.min("t") != F.max("t")).alias("_v")).filter("_v")
    places = varying.groupBy("n").agg(F.array_sort(F.collect_list("p")).alias("places"))
    whole = lambda seed: F.aggregate(F.transform("vec", lambda t, k: _cell_hash(t, k, seed)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))
    hashed = distinct.select("i", "vec", F.size("vec").alias("n"), whole("h1").alias("h1"), whole("h2").alias("h2"))
    rows = join_lookup(hashed, places, "n", ["i"]).withColumn("p", F.explode("places"))
    rows = rows.withColumn("q", F.explode("places")).filter("p < q")
    x, y = F.element_at("vec", F.col("p") + 1), F.element_at("vec", F.col("q") + 1)

    def others(seed: str) -> Column:
        return F.col(seed).bitwiseXOR(_cell_hash(x, F.col("p"), seed)).bitwiseXOR(_cell_hash(y, F.col("q"), seed))

    key = F.struct("n", "p", "q", others("h1").alias("h1"), others("h2").alias("h2")).alias("key")
    return rows.select("i", key, x.alias("x"), y.alias("y"))


def _cell_hash(token: Column, place: Column, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), place.cast("int"), token)


def _masked(vec: str | Column, p: Column, q: Column) -> Column:
    return F.transform(vec, lambda t, k: F.when((k == p) | (k == q), F.lit(ANY_TOKEN).cast("bigint")).otherwise(t))


def _partners(buckets: DataFrame) -> DataFrame:
    """``(i, j, key)``: for each vector the lowest other one that differs in exactly two places.

    Within a bucket only six vectors can be anyone's answer, and they come from three rounds
    of minimums: the first one; the first that differs from it in x, in y, in both; and
    the first that in addition differs from those in the other place.  No pairs are formed.
    """
    one = F.min(F.struct("i", "x", "y"))
    first = buckets.groupBy("key").agg(one.alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    rows = materialise(buckets.join(first, "key"), "bucket-first")
    other_x, other_y = F.col("x") != F.col("a.x"), F.col("y") != F.col("a.y")
    me = F.struct("i", "x", "y")
    second = rows.groupBy("key").agg(
        F.min(F.when(other_x, me)).alias("bx"),
        F.min(F.when(other_y, me)).alias("by"),
        F.min(F.when(other_x & other_y, F.col("i"))).alias("bxy"),
    )
    before = rows
    rows = materialise(rows.join(second, "key"), "bucket-second")
    discard(before)
    third = rows.groupBy("key").agg(
        F.min(F.when(other_x & (F.col("y") != F.col("bx.y")), F.col("i"))).alias("cx"),
        F.min(F.when(other_y & (F.col("x") != F.col("by.x")), F.col("i"))).alias("cy"),
    )
    partner = (
        F.when(other_x & other_y, F.col("a.i"))
        .when(other_y, F.when(F.col("bx.y") != F.col("y"), F.col("bx.i")).otherwise(F.col("cx")))
        .when(other_x, F.when(F.col("by.x") != F.col("x"), F.col("by.i")).otherwise(F.col("cy")))
        .otherwise(F.col("bxy"))
    )
    found = rows.join(third, "key").select("i", "key", partner.alias("j")).filter("j is not null")
    return found.groupBy("i").agg(F.min(F.struct("j", "key")).alias("m")).select("i", "m.j", "m.key")


def hamming_partners(vectors: DataFrame) -> DataFrame:
    """``(i, j, p, q)``: each distinct vector's lowest partner that differs in exactly two places."""
    found = _partners(materialise(_buckets(_distinct(vectors)), "buckets"))
    return found.select("i", "j", "key.p", "key.q")


def hamming_links(vectors: DataFrame, d: int = 2) -> DataFrame:
    """``(vec_id, i, copies, links)``: each vector with its class of equal ones, and how many other classes differ in exactly ``d`` places.

    ``i`` is the lowest vector of the class.  Classes are counted, not paired, so dense vectors cost no more than sparse ones: for
    every set of at most ``d`` varying places, a bucket counts the classes that agree in all other places.  A class that
    differs in s places from another agrees outside every set that holds these, so with ``v`` varying places the sum over the sets
    of t places, times ``C(v - t, d - t)``, less for odd ``d - t``, leaves those with s = d.  Vectors of different lengths never meet.
    """
    if d < 1:
        raise ValueError("classes differ in one place at least")
    distinct = materialise(_distinct(vectors), "distinct")
    cells = distinct.select(F.size("vec").alias("n"), F.posexplode("vec").alias("p", "t"))
    varying = cells.groupBy("n", "p").agg((F.min("t") != F.max("t")).alias("_v"))
    places = varying.groupBy("n").agg(F.array_sort(F.collect_list(F.when(F.col("_v"), F.col("p")))).alias("places"))
    sets = places.select("n", "places", F.array().cast("array<int>").alias("hidden"))
    every = sets
    for _ in range(d):
        grown = sets.withColumn("_p", F.explode("places")).filter(F.coalesce(F.array_max("hidden"), F.lit(-1)) < F.col("_p"))
        sets = grown.select("n", "places", F.concat("hidden", F.array("_p")).alias("hidden"))
        every = every.unionByName(sets)
    left, t = F.size("places") - F.size("hidden"), F.size("hidden")
    weight = F.lit(0).cast("bigint")
    for size in range(d + 1):
        ways = F.lit(1).cast("bigint")
        for j in range(d - size):
            ways = F.call_function("div", ways * (left - j), F.lit(j + 1))
        weight = F.when(t == size, ways * (-1) ** (d - size)).otherwise(weight)
    every = every.select("n", "hidden", weight.cast("bigint").alias("weight"))
    rows = join_lookup(distinct.select("i", "vec", F.size("vec").alias("n")), every, "n", ["i"])

    def shown(seed: str) -> Column:
        cells_ = F.transform("vec", lambda x, k: F.when(~F.array_contains("hidden", k), _cell_hash(x, k, seed)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(cells_, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))

    key = F.struct("n", "hidden", shown("h1").alias("h1"), shown("h2").alias("h2")).alias("key")
    rows = materialise(rows.select("i", "weight", key), "hidden")
    # Written, as each is read three times by the join.
    counts = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")), "bucket-counts")
    links = join_counted(rows, counts, "key", "_n").groupBy("i").agg(F.sum(F.col("weight") * F.col("_n")).alias("links"))
    classes = materialise(distinct.select("vec", "i", F.col("cnt").alias("copies")).join(links, "i"), "classes")
    discard(rows, counts)
    return join_counted(vectors.select("vec_id", "vec"), classes, "vec", "copies").select("vec_id", "i", "copies", "links")


@dataclass
class Rules:
    """``rules(rule_id, i, j, p, q, rule)`` in the order found and ``matches(vec_id, rule_id)``."""

    rules: DataFrame
    matches: DataFrame


def mine_rules(vectors: DataFrame, max_rules: int | None = None) -> Rules:
    """Repeat: the lowest pair that differs in exactly two places makes a rule, its matches leave.

    The one-by-one rule goes through the vectors in order.  A vector that is the lowest of all its buckets makes its
    rule as soon as no vector that would leave with it shares a bucket with a lower one, whose choice it could still be; without
    a partner it is closed, since it cannot get one later.  Each round lets all such vectors go ahead together, and
    chains of vectors that each wait for one other go ahead whole (:func:`_chain_turns`).

    ``max_rules`` stops once that many rules are certain to be the first ones.
    """
    distinct = materialise(_distinct(vectors), "distinct")
    buckets = materialise(_buckets(distinct), "buckets")
    still_open = materialise(buckets.join(_partners(buckets).select("i"), "i", "left_semi"), "open")
    made: list[DataFrame] = []
    while not still_open.isEmpty():
        lowest = still_open.groupBy("key").agg(F.min(F.struct("i", "x", "y")).alias("a"), F.count(F.lit(1)).alias("n"))
        rows = materialise(still_open.join(lowest, "key"), "bucket-lowest")
        both_differ = (F.col("x") != F.col("a.x")) & (F.col("y") != F.col("a.y"))
        partner = rows.groupBy("key").agg(
            F.first("a.i").alias("i"), F.first("n").alias("n"), F.min(F.when(both_differ, F.col("i"))).alias("j")
        )
        first = partner.groupBy("i").agg(F.min(F.when(F.col("j").isNotNull(), F.struct("j", "key", "n"))).alias("m")).select("i", "m.*")
        below = F.when(F.col("a.i") < F.col("i"), F.col("a.i"))
        reach = rows.groupBy("i").agg(
            F.min("a.i").alias("lowest"), F.min(below).alias("low"), F.max(below).alias("high"), F.max((F.col("a.i") < F.col("i")) & (F.col("n") > 2)).alias("crowded")
        )
        each = materialise(reach.join(first, "i", "left"), "reach")
        own = each.filter("low is null")
        # A rule waits while any vector that would leave with it is within reach of a lower one.
        leave = rows.join(own.select("key"), "key", "left_semi").select("key", "i", F.col("a.i").alias("maker"))
        safe = leave.join(each.select("i", "lowest"), "i").groupBy("key").agg((F.min("lowest") == F.first("maker")).alias("_safe")).filter("_safe")
        turn = own.filter("j is null").select("i", "j", "key").unionByName(own.join(safe, "key", "left_semi").select("i", "j", "key"))
        turn = materialise(turn, "turn")
        if CHAIN_SHARE * turn.count() < each.count():
            turn = materialise(turn.unionByName(_chain_turns(each)).distinct(), "turn")
        ready = turn.filter("j is not null")
        made.append(ready)
        leaving = rows.join(ready.select("key"), "key", "left_semi").select("i").unionByName(turn.filter("j is null").select("i"))
        before = still_open
        still_open = materialise(rows.select("i", "key", "x", "y").join(leaving.distinct(), "i", "left_anti"), "open")
        discard(before, rows, each)
        if max_rules is not None and _certain(made, still_open, max_rules):
            break

    rules = buckets.limit(0).select("i", F.col("i").alias("j"), "key")
    for part in made:
        rules = rules.unionByName(part)
    numbered = number_rows(rules, ["i"], "rule_id")
    found = materialise(numbered if max_rules is None else numbered.filter(F.col("rule_id") <= max_rules), "rules")
    rules = found.join(distinct.select("i", "vec"), "i").select(
        "i", "j", "key.p", "key.q", _masked("vec", F.col("key.p"), F.col("key.q")).alias("rule"), "rule_id"
    )
    # A vector left with the first rule that fits it.
    by_key = found.select("rule_id", "key")
    hits = buckets.join(by_key, "key").groupBy("i").agg(F.min("rule_id").alias("rule_id"))
    matched = distinct.select("vec", "i").join(hits, "i").select("vec", "rule_id")
    return Rules(rules, vectors.join(matched, "vec").select("vec_id", "rule_id"))


def _certain(made: list[DataFrame], still_open: DataFrame, max_rules: int) -> bool:
    """Whether ``max_rules`` rules come before all that the open vectors can still make."""
    least = still_open.agg(F.min("i")).first()[0]
    return sum((m if least is None else m.filter(F.col("i") < least)).count() for m in made) >= max_rules


def _chain_turns(each: DataFrame) -> DataFrame:
    """``(i, j, key)`` of the vectors in chains that go ahead now, as maker of a rule or, with a null ``j``, closed.

    Of a vector that shares buckets with just one lower vector, and with that one alone, the fate hangs on that one: it
    leaves if the lower one is open in its turn and has it as partner, else it stays.  So along a chain of partners the
    vectors go and stay by turns, and the parity of the distance to the head of the chain tells which; the distance comes from
    pointers followed by doubling.  A head has no lower vector, or is not the partner of its one.  The choice of a vector is known
    beforehand if its lowest partner waits for nobody else.
    """
    single = (F.col("low") == F.col("high")) & ~F.col("crowded")
    state = each.withColumn("single", F.coalesce(single, F.lit(False)))
    other = state.select(F.col("i").alias("j"), F.col("single").alias("_s"), F.col("low").alias("_l"))
    sure = F.col("j").isNull() | ((F.col("n") == 2) & F.col("_s") & (F.col("_l") == F.col("i")))
    state = state.join(other, "j", "left").withColumn("known", ~F.col("crowded") & F.coalesce(sure, F.lit(False)))
    state = materialise(state.select("i", "low", "single", "j", "key", "known"), "chain-state")
    above = state.filter(F.col("known") & (F.col("low").isNull() | F.col("single"))).select(F.col("i").alias("low"), F.col("j").alias("_partner"))
    waits = state.filter("single").join(above, "low").withColumn("follows", F.coalesce(F.col("_partner") == F.col("i"), F.lit(False)))
    heads = state.filter("low is null").select("i", F.col("i").alias("to"), F.lit(0).alias("odd"))
    chained = waits.select("i", F.when(F.col("follows"), F.col("low")).otherwise(F.col("i")).alias("to"), F.col("follows").cast("int").alias("odd"))
    pointers = materialise(heads.unionByName(chained), "pointers")
    left = pointers.filter("i <> to").count()
    while left:
        on = pointers.select(F.col("i").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
        before = pointers
        # Pointers to vectors of unknown fate drop out.
        pointers = materialise(pointers.join(on, "to").select("i", F.col("_to").alias("to"), F.col("odd").bitwiseXOR(F.col("_odd")).alias("odd")), "pointers")
        ends = before.filter("i = to").select(F.col("i").alias("to"))
        left = pointers.join(ends, "to", "left_anti").count()
        discard(before)
    stays = pointers.filter("odd = 0").select("i")
    return state.filter("known and low is not null").join(stays, "i").select("i", "j", "key")


def rule_values(rules: Rules, vectors: DataFrame) -> DataFrame:
    """``(rule_id, place, side, token)``: the two values of the founding pair at each masked place."""
    named = vectors.select(F.col("vec_id"), "vec")
    sides = rules.rules.select("rule_id", "p", "q", F.posexplode(F.array("i", "j")).alias("side", "vec_id")).join(named, "vec_id")
    return sides.select("rule_id", "side", "vec", F.explode(F.array("p", "q")).alias("place")).select(
        "rule_id", "place", "side", F.element_at("vec", F.col("place") + 1).alias("token")
    )


def shared_values(values: DataFrame) -> DataFrame:
    """``(token, rule_id, rules)``: the rules each value is used in, and how many there are."""
    used = values.select("token", "rule_id").distinct()
    return used.join(used.groupBy("token").agg(F.count(F.lit(1)).alias("rules")), "token")


def rule_coverage(rules: Rules) -> DataFrame:
    """Vectors that matched each rule when it was made."""
    return rules.matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("cnt"))


def match_rules(vectors: DataFrame, rules: DataFrame) -> DataFrame:
    """``(vec_id, rule_id)`` for every rule a vector fits, with rules from another run.

    Rules and vectors meet on the masked vector, so only fitting pairs come together.
    """
    shapes = rules.select(F.size("rule").alias("n"), "p", "q").distinct()
    keyed = join_lookup(vectors.withColumn("n", F.size("vec")), shapes, "n", ["vec_id"])
    keyed = keyed.select("vec_id", "p", "q", _masked("vec", F.col("p"), F.col("q")).alias("rule"))
    return keyed.join(rules.select("rule_id", "p", "q", "rule"), ["p", "q", "rule"]).select("vec_id", "rule_id")


def retokenise(rules: Rules, values: DataFrame) -> DataFrame:
    """The founding vectors again, from each rule and its values: ``(rule_id, side, vec)``."""
    filled = values.groupBy("rule_id", "side").agg(F.map_from_entries(F.collect_list(F.struct("place", "token"))).alias("at"))
    vec = F.transform("rule", lambda t, k: F.coalesce(F.try_element_at(F.col("at"), k), t))
    return filled.join(rules.rules.select("rule_id", "rule"), "rule_id").select("rule_id", "side", vec.alias("vec"))
