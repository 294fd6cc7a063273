"""Equi joins, lookups, backfills and provenance. Sides of unknown size carry no broadcast hint:
the automatic broadcast checks their size, AQE splits skewed keys otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emipanel import dims
from emipanel.functions.core import as_col
from emipanel.functions.geo import grid_key, in_radius, snap, valid_coord
from emipanel.functions.numeric import log10_pos
from emipanel.operators.skew import first_per_key, join_null_safe


def left_join(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.join(b, list(keys), "left")


def inner_join(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.join(b, list(keys), "inner")


def semi(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_semi")


def anti(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


def lookup_chain(df: DataFrame, steps) -> DataFrame:
    """Chained dictionary lookups. ``steps``: list of (table, key in df, key in table)."""
    for table, left, right in steps:
        other = table.withColumnRenamed(right, "__k")
        df = df.join(other, F.col(left) == F.col("__k"), "left").drop("__k")
    return df


def fx_to_musd(df: DataFrame, cols, currency: str = "currency", in_units: bool = False) -> DataFrame:
    """Local amounts (millions, or units) to million USD; an unknown currency gives null."""
    rates = F.broadcast(dims.fx(df.sparkSession).withColumnRenamed("currency", "__cur"))
    out = df.join(rates, F.upper(F.trim(F.col(currency))) == F.col("__cur"), "left")
    scale = F.lit(1e6 if in_units else 1.0)
    out = out.withColumns({c: F.try_divide(F.col(c), F.col("local_per_usd")) / scale for c in cols})
    return out.withColumn(currency, F.col("__cur")).drop("__cur", "local_per_usd")


def resolve_with_source(df: DataFrame, primary: str, fallback: str, value: str = "sector",
                        source: str = "sector_source", names=("primary", "fallback")) -> DataFrame:
    """Mapped primary label, else the stripped fallback; says which one it was."""
    table = F.broadcast(dims.sectors(df.sparkSession))
    out = df.join(table, F.col(primary) == F.col("sector_raw"), "left")
    other = F.nullif(F.trim(fallback), F.lit(""))
    out = out.withColumn(value, F.coalesce("sector_mapped", other))
    label = F.when(F.col("sector_mapped").isNotNull(), names[0]).when(other.isNotNull(), names[1])
    return out.withColumn(source, label).drop("sector_raw", "sector_mapped")


def map_region(df: DataFrame, iso: str, factor_regions: DataFrame, region: str = "factor_region") -> DataFrame:
    """A country with factors of its own, else its rest-of-world bucket, else null.

    ``factor_regions(iso2)``: the regions of the factor table.
    """
    own = factor_regions.select(F.col("iso2").alias("__own")).distinct()
    rest = F.broadcast(dims.rest_of_world(df.sparkSession).select(F.col("iso2").alias("__row"), "bucket"))
    out = df.join(own, F.col(iso) == F.col("__own"), "left").join(rest, F.col(iso) == F.col("__row"), "left")
    return out.withColumn(region, F.coalesce("__own", "bucket")).drop("__own", "__row", "bucket")


def region_of(df: DataFrame, iso: str, name: str = "world_region") -> DataFrame:
    table = F.broadcast(dims.world_regions(df.sparkSession).withColumnRenamed("iso2", "__iso")
                        .withColumnRenamed("world_region", "__wr"))
    return (df.join(table, F.col(iso) == F.col("__iso"), "left")
            .withColumn(name, F.coalesce("__wr", F.lit("Other"))).drop("__iso", "__wr"))


def iso_codes(df: DataFrame, country: str, table: DataFrame) -> DataFrame:
    """``table(country_name, country_iso2, country_iso3)``; an unmatched name gives nulls."""
    t = table.select(F.lower(F.trim("country_name")).alias("__c"), "country_iso2", "country_iso3")
    return df.join(t, F.lower(F.trim(F.col(country))) == F.col("__c"), "left").drop("__c")


def factor_join(df: DataFrame, factors: DataFrame, region: str, sector: str, year: str,
                max_year: int = 2022, factor: str = "factor_tco2e_per_musd") -> DataFrame:
    """Factor of (region, sector, year), years beyond the last published one using that one."""
    f = factors.select(F.col("region").alias("__fr"), F.col("sector").alias("__fs"),
                       F.col("year").alias("__fy"), F.col("factor").alias(factor))
    cond = ((F.col(region) == F.col("__fr")) & (F.col(sector) == F.col("__fs"))
            & (F.least(F.col(year), F.lit(max_year)) == F.col("__fy")))
    return df.join(f, cond, "left").drop("__fr", "__fs", "__fy")


def backfill_from_history(df: DataFrame, entity: str, cols, order, source: str | None = None,
                          label: str = "history_backfill", together: bool = False) -> DataFrame:
    """Missing values from the entity's first row that has all of ``cols``.

    ``together=False`` fills each column on its own; ``together=True`` overwrites all of them in a
    row that misses any. Only filled rows get the ``source`` label.
    """
    have, miss = F.lit(True), F.lit(False)
    for c in cols:
        have, miss = have & F.col(c).isNotNull(), miss | F.col(c).isNull()
    names = [f"__h{i}" for i in range(len(cols))]
    known = first_per_key(df.where(have).select(entity, *cols, *[o.alias(f"__o{i}") if isinstance(o, Column)
                                                                  else F.col(o).alias(f"__o{i}")
                                                                  for i, o in enumerate(order)]),
                          [entity], [F.col(f"__o{i}") for i in range(len(order))])
    known = known.select(entity, *[F.col(c).alias(n) for c, n in zip(cols, names)])
    out = df.join(known, entity, "left")
    if source:
        filled = miss & F.col(names[0]).isNotNull()
        out = out.withColumn(source, F.when(filled, label).otherwise(F.col(source)))
    new = {c: (F.when(miss, F.col(n)).otherwise(F.col(c)) if together else F.coalesce(F.col(c), F.col(n)))
           for c, n in zip(cols, names)}
    return out.withColumns(new).drop(*names)


def merge_with_provenance(df: DataFrame, side: DataFrame, keys, order, centres: DataFrame | None = None,
                          label: str = "geocoded_address", source: str = "coord_source") -> DataFrame:
    """Fill missing coordinates from a side table of geocoded points.

    Points far from their city centre are dropped, one point per key is kept (the first by
    ``order``), an existing provenance label is preserved and a blank one initialised.
    """
    keys = list(keys)
    side = side.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if centres is not None:
        c = centres.withColumnRenamed("city", "__city")
        side = (side.join(c, F.col("city") == F.col("__city"), "left")
                .where(in_radius("latitude", "longitude", "centre_lat", "centre_lon"))
                .drop("__city", "centre_lat", "centre_lon"))
    side = first_per_key(side, keys, order).select(*keys, F.col("latitude").alias("__lat"),
                                                   F.col("longitude").alias("__lon"))
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    initial = F.when(own, "city_disclosure").otherwise("missing")
    if source in df.columns:
        initial = F.coalesce(F.when(F.trim(F.col(source)) != "", F.col(source)), initial)
    out = df.withColumn(source, initial).join(side, keys, "left")
    fill = F.col("latitude").isNull() & F.col("__lat").isNotNull()
    return (out.withColumn(source, F.when(fill, label).otherwise(F.col(source)))
            .withColumn("longitude", F.when(fill, F.col("__lon")).otherwise(F.col("longitude")))
            .withColumn("latitude", F.when(fill, F.col("__lat")).otherwise(F.col("latitude")))
            .drop("__lat", "__lon"))


def location_or_fallback(df: DataFrame, centres: DataFrame, city: str = "city", year: str = "year",
                         source: str = "climate_source") -> DataFrame:
    """Own coordinates when valid, else the city centre, on the climate grid, with the query key. A city without a centre is
    refused with an error, so no row is lost."""
    c = centres.withColumnRenamed("city", "__city")
    unknown = F.raise_error(F.concat(F.lit("no centre for city "), F.coalesce(F.col(city), F.lit("null"))))
    out = df.join(c, F.col(city) == F.col("__city"), "left")
    out = out.withColumn("centre_lat", F.when(F.col("__city").isNull(), unknown.cast("double")).otherwise(F.col("centre_lat"))).drop("__city")
    ok = valid_coord("latitude", "longitude", "centre_lat", "centre_lon")
    return (out.withColumn(source, F.when(ok, "building_grid").otherwise("city_fallback"))
            .withColumn("grid_lat", snap(F.when(ok, F.col("latitude")).otherwise(F.col("centre_lat"))))
            .withColumn("grid_lon", snap(F.when(ok, F.col("longitude")).otherwise(F.col("centre_lon"))))
            .withColumn("query_key", grid_key("grid_lat", "grid_lon", year))
            .drop("centre_lat", "centre_lon"))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_preserves_rows(right: DataFrame, keys) -> None:
    """A left join keeps its row count exactly when the right keys are unique."""
    bad = duplicate_keys(right, keys).limit(10).collect()
    if bad:
        raise ValueError(f"join would multiply rows; repeated keys: {[tuple(r)[:-1] for r in bad]}")


def left_join_preserving(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Left join whose use fails if a key occurs twice in ``b``, so that no write with multiplied rows can succeed.

    Keys are counted on the way to the join, in the shuffle it needs itself: nothing runs while the join is defined and ``b`` is
    read once. Rows of ``b`` with a null key match nothing and may repeat.
    """
    keys = list(keys)
    rest = [c for c in b.columns if c not in keys]
    counted = b.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(1).alias("__one"))).alias("__b"))
    message = F.concat(F.lit("join would multiply rows; repeated key: "), F.to_json(F.struct(*keys)))
    single = counted.where(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return left_join(a, single.select(*keys, *[F.col(f"__b.`{c}`").alias(c) for c in rest]), keys)


def fan_out(plan: DataFrame, key: str, compute) -> DataFrame:
    """Distinct keys, computed once each, joined back to every row that asked."""
    return plan.join(compute(plan.select(key).distinct()), key, "left")


def attach_target(df: DataFrame, other: DataFrame, keys, target: str, order, how: str = "inner") -> DataFrame:
    """Target of another table by composite key, the first row per key deciding."""
    keys = list(keys)
    one = first_per_key(other.select(*keys, target, *[as_col(o).alias(f"__o{i}") for i, o in enumerate(order)]),
                        keys, [F.col(f"__o{i}") for i in range(len(order))])
    return df.join(one.select(*keys, target), keys, how)


def entity_dim(df: DataFrame, entity: str, cols, order) -> DataFrame:
    """One metadata row per entity."""
    keep = df.select(entity, *cols, *[as_col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    return first_per_key(keep, [entity], [F.col(f"__o{i}") for i in range(len(order))]).select(entity, *cols)


def relabel(df: DataFrame, mapping: DataFrame, key: str, col: str, new: str) -> DataFrame:
    """New label where the map has the key, the old one elsewhere."""
    m = mapping.select(F.col(key).alias("__k"), F.col(new).alias("__new"))
    return (df.join(m, F.col(key) == F.col("__k"), "left")
            .withColumn(col, F.coalesce("__new", F.col(col))).drop("__k", "__new"))


def align_predictions(test: DataFrame, preds: DataFrame, keys, pred: str, out: str = "pred_log") -> DataFrame:
    """Predictions by key; missing and non-positive ones become null in log space."""
    joined = test.join(preds.select(*keys, pred), list(keys), "left")
    return joined.withColumn(out, log10_pos(pred))


def _tokens(c) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.trim(as_col(c))), r"[^\p{L}\p{N}]+"),
                                                  lambda t: t != "")))


def token_set_score(a: Column, b: Column) -> Column:
    """100 x the best ratio between the shared tokens and either name: 2s / (s + m), s and m being the lengths of the shared tokens and of
    the shorter name, tokens joined by spaces. It is 100 where one name holds the other; tokens that differ count as wholly different."""
    def length(tokens):
        return F.aggregate(tokens, F.lit(0), lambda n, x: n + F.length(x)) + F.size(tokens) - 1

    s = length(F.array_intersect(a, b))
    return F.when(F.size(F.array_intersect(a, b)) == 0, 0.0).otherwise(F.lit(200.0) * s / (s + F.least(length(a), length(b))))


def _rarity_ordered(names: DataFrame, freq: DataFrame) -> DataFrame:
    """name, set, m (length) and its tokens from the rarest on: o of (df, token, w), w being what a token adds to the length."""
    tokens = (names.select("name", F.explode("set").alias("token")).join(freq, "token")
              .groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "token", (F.length("token") + 1).alias("w")))).alias("o")))
    return names.join(tokens, "name").withColumn("m", F.aggregate("o", F.lit(0), lambda n, x: n + x["w"]) - 1)


def _pairs_of(tokens) -> Column:
    """Keys of all pairs of an array of tokens, in its order."""
    return F.flatten(F.transform(tokens, lambda x, i: F.transform(
        F.slice(tokens, i + 2, F.greatest(F.size(tokens) - i - 1, F.lit(0))), lambda y: F.concat_ws(" ", x, y))))


def _index_keys(named: DataFrame, c: float) -> DataFrame:
    """Keys under which a name is found by every longer name that shares enough of it.

    It needs shared tokens of weight c * m + 1. A token from which on the rest (rarest first) is lighter than that cannot be the
    rarest shared one. Where no single token is heavy enough, two must be shared, and the second rarest of them, with the heaviest
    token added to what follows it, must reach the weight; then pairs are the keys, so common words alone build no candidates.
    """
    need = F.lit(c) * F.col("m") + 1 - 1e-9
    after = F.transform("o", lambda x, i: F.aggregate(F.slice("o", i + 1, F.size("o")), F.lit(0), lambda n, y: n + y["w"]))
    heaviest = F.array_max(F.transform("o", lambda x: x["w"]))
    named = named.withColumn("after", after).withColumn("top", heaviest)
    one = F.transform(F.filter("o", lambda x, i: F.get("after", i) >= need), lambda x: x["token"])
    two = F.transform(F.filter("o", lambda x, i: F.get("after", i) + F.col("top") >= need), lambda x: x["token"])
    return named.select("name", "m", F.explode(F.when(F.col("top") >= need, one).otherwise(_pairs_of(two))).alias("key"))


def _probe_keys(named: DataFrame) -> DataFrame:
    """Every token and every pair of tokens of a name."""
    tokens = F.transform("o", lambda x: x["token"])
    return named.select("name", "m", F.explode(F.concat(tokens, _pairs_of(tokens))).alias("key"))


def fuzzy_match(left: DataFrame, right: DataFrame, left_name: str, right_name: str, threshold: int = 60,
                symbol: str | None = None, max_symbol_len: int = 12) -> DataFrame:
    """Best right name per left name by the token-set ratio (``token_set_score``) of at least ``threshold``.

    A name is indexed under its rarest tokens, or pairs of them, and probed with all tokens and pairs of every name that is as long or
    longer, so a name that lies in another is found and no pair that reaches the threshold is missed. Distinct names are compared,
    not rows; a key that many names have is dealt out over tasks by Spark's skew join, and which names meet under it is what the score
    decides. Ties go to the smallest name. Names without tokens match nothing.
    """
    t = threshold / 100.0
    c = t / (2.0 - t)
    if symbol:
        right = right.where(F.length(symbol) <= max_symbol_len)

    def distinct(df, name):
        return df.select(F.col(name).alias("name")).distinct().withColumn("set", _tokens("name")).where(F.size("set") > 0)

    lset, rset = distinct(left, left_name), distinct(right, right_name)
    freq = (lset.select("set").union(rset.select("set")).select(F.explode("set").alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    lname, rname = _rarity_ordered(lset, freq), _rarity_ordered(rset, freq)

    def meet(small, large, small_as, large_as, or_equal):
        s = _index_keys(small, c).select("key", F.col("name").alias(small_as), F.col("m").alias("sm"))
        g = _probe_keys(large).select("key", F.col("name").alias(large_as), F.col("m").alias("gm"))
        fits = F.col("sm") <= F.col("gm") if or_equal else F.col("sm") < F.col("gm")
        return s.join(g, "key").where(fits).select("l_name", "r_name")

    cand = meet(lname, rname, "l_name", "r_name", True).unionByName(meet(rname, lname, "r_name", "l_name", False)).distinct()
    scored = (cand.join(lset.select(F.col("name").alias("l_name"), F.col("set").alias("l_set")), "l_name")
              .join(rset.select(F.col("name").alias("r_name"), F.col("set").alias("r_set")), "r_name")
              .select("l_name", "r_name", token_set_score(F.col("l_set"), F.col("r_set")).alias("score")))
    best = first_per_key(scored.where(F.col("score") >= threshold), ["l_name"], [-F.col("score"), F.col("r_name")])
    return left.join(best, F.col(left_name) == F.col("l_name"), "left").drop("l_name").withColumnRenamed(
        "r_name", "matched_name")
