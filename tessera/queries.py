"""One query for each operator over the given tables, with DuckDB SQL for the same rows.

Key columns of the tables are dense from 0 and serve as row indices and parent numbers."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import generators as g
from tessera.functions import names, rules
from tessera.functions.draws import Cell, permuted_sql, pick, pick_sql, uniform_sql
from tessera.operators import assign, reports, shared, validate
from tessera.operators.ranks import cumulative, numbered
from tessera.sinks import cells

SEED = 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, name: str = "orders", key: str = "o_orderkey") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("idx"))


def cell(column: str, name: str = "gen") -> Cell:
    return Cell(SEED, name, column, F.col("idx"))


def u(column: str, kind: str = "value", idx: str = "idx", name: str = "gen") -> str:
    return uniform_sql(SEED, name, f"{column}/{kind}", idx)


ROWS = "(SELECT o_orderkey AS idx FROM orders)"

# generators


@query(f"SELECT idx, (-20 + {pick_sql(u('v'), 121)})::BIGINT AS v FROM {ROWS}")
def gen_uniform_int(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.integer_range(cell("v"), -20.5, 100).alias("v"))


@query(f"SELECT idx, (3501 + {pick_sql(u('v'), 41500)}) / 100.0::DOUBLE AS v, (10 + {pick_sql(u('w'), 11)}) * 0.5::DOUBLE AS w FROM {ROWS}")
def gen_numeric_scale(spark, sf_dir):
    v = g.numeric_range(cell("v"), 35, "450", 2, precision=7, min_exclusive=True)
    w = g.numeric_range(cell("w"), 5, 10, 1, precision=7, step="0.5")
    return rows(spark, sf_dir).select("idx", v.cast("double").alias("v"), w.cast("double").alias("w"))


@query(f"SELECT idx, 2.5::DOUBLE + {u('v')} * 5.0::DOUBLE AS v FROM {ROWS}")
def gen_float(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.float_range(cell("v"), 2.5, 7.5).alias("v"))


@query(
    f"SELECT idx, (DATE '2015-01-01' + {pick_sql(u('d'), 3654)}::INT)::DATE AS d,"
    f" strftime(TIMESTAMP '2020-02-28 12:00:00' + to_seconds({pick_sql(u('t'), 86401)}), '%Y-%m-%d %H:%M:%S') AS t FROM {ROWS}"
)
def gen_datetime_range(spark, sf_dir):
    t = g.timestamp_range(cell("t"), dt.datetime(2020, 2, 28, 12), dt.datetime(2020, 2, 29, 12))
    return rows(spark, sf_dir).select("idx", g.date_range(cell("d")).alias("d"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t"))


@query(
    f"SELECT idx, CASE WHEN {u('a')} < 0.5 THEN 'x' WHEN {u('a')} < 0.75 THEN 'y' ELSE 'z' END AS a,"
    f" list_extract(['p', 'q', 'r'], {pick_sql(u('b'), 3)} + 1) AS b FROM {ROWS}"
)
def gen_choice(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.choice(cell("a"), ["x", "y", "z"], [2, 1, 1]).alias("a"), g.choice(cell("b"), ["p", "q", "r"]).alias("b"))


@query(f"SELECT idx, 10 + idx * 5 AS s, 'gen_code_' || (idx + 100) || '!' AS t FROM {ROWS}")
def gen_sequence_template(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.sequence(cell("s"), 10, 5).alias("s"), g.template(cell("code"), "{table}_{column}_{n}!", 100).alias("t"))


@query(
    f"""SELECT idx, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-'
    || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT idx, sha256('42|3:gen|' || idx || '|id/uuid') AS h FROM {ROWS})"""
)
def gen_uuid(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.uuid4(cell("id")).alias("id"))


@query(
    f"SELECT idx, {pick_sql(u('i'), 1001)} AS i, {pick_sql(u('n'), 100001)} / 100.0::DOUBLE AS n, {u('b')} < 0.5 AS b,"
    f" (DATE '2015-01-01' + {pick_sql(u('d'), 3654)}::INT)::DATE AS d, '{{}}' AS j, list_extract(['lo', 'hi'], {pick_sql(u('e'), 2)} + 1) AS e,"
    f" substr('gen_t_' || substr(sha256('42|3:gen|' || idx || '|t/text'), 1, 8), 1, 12) AS t FROM {ROWS}"
)
def gen_fallback(spark, sf_dir):
    made = {"i": ("integer", {}), "n": ("numeric", {}), "b": ("boolean", {}), "d": ("date", {}), "j": ("json", {}), "e": ("enum", {"values": ["lo", "hi"]}), "t": ("text", {"length": 12})}
    columns = {c: g.fallback(cell(c), kind, **params) for c, (kind, params) in made.items()}
    return rows(spark, sf_dir).withColumns(columns | {"n": columns["n"].cast("double")})


@query(f"SELECT idx, CASE WHEN {u('v', 'null')} >= 0.3 THEN {pick_sql(u('v'), 11)} END AS v FROM {ROWS}")
def gen_null_ratio(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.nullable(cell("v"), 0.3, g.integer_range(cell("v"), 0, 10)).alias("v"))


@query(
    f"""SELECT idx, array_to_string(list_transform(range(1, 1 + {pick_sql(u('v', 'len'), 6)}), lambda k: {pick_sql("(('0x' || substr(sha256('42|3:gen|' || idx || '|v/e/' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)", 100)}), ',') AS v FROM {ROWS}"""
)
def gen_array(spark, sf_dir):
    v = g.array_of(cell("v"), lambda k: pick(cell("v").u("e", k), 100))
    return rows(spark, sf_dir).select("idx", F.array_join(v.cast("array<string>"), ",").alias("v"))


def _redraws(column: str, value: str, low: float, high: float, tries: int) -> str:
    draw = lambda kind: f"(('0x' || substr(sha256('42|3:gen|' || idx || '|{column}/{kind}/' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    z = f"sqrt(-2 * ln(1 - {draw('z.r')})) * cos(2 * pi() * {draw('z.t')})"
    return f"""WITH x AS (SELECT idx, list_transform(range(1, {tries + 1}), lambda k: {value.format(z=z)}) AS xs FROM {ROWS})
    SELECT idx, floor(coalesce(list_filter(xs, lambda x: x BETWEEN {low} AND {high})[1], greatest({low}, least({high}, xs[1]))) * 10000 + 0.5) / 10000 AS {column} FROM x"""


@query(_redraws("v", "50.0::DOUBLE + 20.0::DOUBLE * {z}", 0, 100, 5))
def gen_normal(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.rounded(g.normal(cell("v"), 0, 100, 50, 20), 4).alias("v"))


@query(_redraws("v", "exp(4.499809670330265::DOUBLE + 0.45::DOUBLE * {z})", 35, 450, 6))
def gen_lognormal(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.rounded(g.lognormal(cell("v"), 35, 450, 90, 0.45), 4).alias("v"))


def _rejected_zipf_sql(low: int, n: str | int, s: float, tag: str = "v/zipf", name: str = "gen", column: str = "v") -> str:
    area = lambda x: f"((pow({x}, {d(1 - s)}) - 1) / {d(1 - s)})"
    d = lambda x: f"{x!r}::DOUBLE"
    plain = lambda x: (x ** (1 - s) - 1) / (1 - s)
    whole = d(plain(n + 0.5)) if isinstance(n, int) else area(f"({n} + 0.5)")
    start, near = plain(1.5) - 1, 2 - (1 + (plain(2.5) - 2**-s) * (1 - s)) ** (1 / (1 - s))
    draw = uniform_sql(SEED, name, f"{tag}/' || k || '", "idx")
    return f"""WITH w AS (SELECT {whole} AS w), y AS (SELECT idx, k, w + {draw} * ({d(start)} - w) AS y FROM {ROWS}, range(1, 41) t(k), w),
    x AS (SELECT idx, k, y, pow(1 + y * {d(1 - s)}, {d(1 / (1 - s))}) AS x FROM y), r AS (SELECT *, greatest(1, least({n}, floor(x + 0.5))) AS r FROM x),
    a AS (SELECT idx, arg_min(r, k) AS r FROM r WHERE r - x <= {d(near)} OR y >= {area("(r + 0.5)")} - pow(r, {d(-s)}) GROUP BY idx)
    SELECT o.idx, ({low - 1} + coalesce(r, 1))::BIGINT AS {column} FROM {ROWS} o LEFT JOIN a USING (idx)"""


@query(_rejected_zipf_sql(10, 5_000_000, 1.3))
def gen_zipf_column(spark, sf_dir):
    """A column's own Zipf values: five million ranks, and none of them is ever a row."""
    return rows(spark, sf_dir).select("idx", g.zipf(cell("v"), 10, 5_000_009, 1.3).alias("v"))


@query(f"SELECT idx, 2 + ({u('f')} + 1.1102230246251565e-16::DOUBLE) * 3 AS f, (-3 + {pick_sql(u('g'), 7)}) * 0.25::DOUBLE AS g FROM {ROWS}")
def gen_float_bounds(spark, sf_dir):
    """Doubles with an open lower bound, and on the multiples of a step."""
    g_ = g.float_range(cell("g"), -1, 1, step=0.25, min_exclusive=True, max_exclusive=True)
    return rows(spark, sf_dir).select("idx", g.float_range(cell("f"), 2, 5, min_exclusive=True).alias("f"), g_.alias("g"))


@query(_rejected_zipf_sql(0, 100, 1.2, "v/fk"))
def gen_zipf(spark, sf_dir):
    return assign.zipf(rows(spark, sf_dir), 100, SEED, "gen", "v").select("idx", F.col("pidx").alias("v"))


@query(
    f"""WITH p AS (SELECT ['Ana','Luis','Marta','Pablo','Lucia','Jorge','Elena','Raul','Ines','Diego','Clara','Hugo'] AS f,
    ['Vega','Rojas','Soler','Marin','Ibarra','Campos','Prieto','Lara','Nieto','Rivas','Duran','Pardo'] AS l)
    SELECT idx, f[{pick_sql(u('n', 'first'), 12)} + 1] || ' ' || l[{pick_sql(u('n', 'last'), 12)} + 1] AS name,
    {pick_sql(u('ip', 'p0'), 256)} || '.' || {pick_sql(u('ip', 'p1'), 256)} || '.' || {pick_sql(u('ip', 'p2'), 256)} || '.' || {pick_sql(u('ip', 'p3'), 256)} AS ip
    FROM {ROWS}, p"""
)
def gen_fake(spark, sf_dir):
    return rows(spark, sf_dir).select("idx", g.fake(cell("n"), "name").alias("name"), g.fake(cell("ip"), "ipv4").alias("ip"))


def _name_sql(column: str, locale: str, kind: str) -> str:
    return names.word_sql(SEED, "gen", column, locale, kind, "idx")


@query(
    f"""SELECT idx, {_name_sql('es', 'es_ES', 'first')} || ' ' || {_name_sql('es', 'es_ES', 'last')} AS es, {_name_sql('en', 'en_US', 'first')} || ' ' || {_name_sql('en', 'en_US', 'last')} AS en,
    {_name_sql('es_city', 'es_ES', 'city')} AS es_city, {_name_sql('en_city', 'en_US', 'city')} AS en_city FROM {ROWS}"""
)
def gen_names(spark, sf_dir):
    """Names of people and places in two locales."""
    made = {"es": g.fake(cell("es"), "name", "es_ES"), "en": g.fake(cell("en"), "name", "en_US"), "es_city": g.fake(cell("es_city"), "city", "es_ES"), "en_city": g.fake(cell("en_city"), "city", "en_US")}
    return rows(spark, sf_dir).withColumns(made)


# parents

N_CUSTOMER = "(SELECT count(*) FROM customer)"


def count(spark, sf_dir, name):
    return table(spark, sf_dir, name).count()


@query(f"SELECT idx, {pick_sql(u('c', 'fk', name='kid'), N_CUSTOMER)} AS pidx FROM {ROWS}")
def fk_uniform(spark, sf_dir):
    return assign.uniform(rows(spark, sf_dir), count(spark, sf_dir, "customer"), SEED, "kid", "c")


@query(_rejected_zipf_sql(0, N_CUSTOMER, 1.3, "c/fk", "kid", "pidx"))
def fk_zipf(spark, sf_dir):
    return assign.zipf(rows(spark, sf_dir), count(spark, sf_dir, "customer"), SEED, "kid", "c", 1.3).select("idx", "pidx")


@query(f"SELECT idx, CASE WHEN {u('c', 'null', name='kid')} >= 0.25 THEN {pick_sql(u('c', 'fk', name='kid'), N_CUSTOMER)} END AS pidx FROM {ROWS}")
def fk_null_ratio(spark, sf_dir):
    return assign.with_nulls(assign.uniform(rows(spark, sf_dir), count(spark, sf_dir, "customer"), SEED, "kid", "c"), 0.25, SEED, "kid", "c")


@query(f"""WITH t AS (SELECT count(*) AS n FROM orders) SELECT c_custkey AS idx, {permuted_sql(SEED, 'kid', 'o/parent', 'c_custkey', 'n')} AS pidx FROM customer, t""")
def fk_unique_subset(spark, sf_dir):
    return assign.unique_subset(rows(spark, sf_dir, "customer", "c_custkey"), count(spark, sf_dir, "orders"), SEED, "kid", "o").select("idx", "pidx")


@query(
    f"""WITH t AS (SELECT {N_CUSTOMER} AS p, {N_CUSTOMER} * 10 AS free, (SELECT count(*) FROM orders) AS n),
    r AS (SELECT idx, p, free, {permuted_sql(SEED, 'kid', 'c/child', 'idx', 'n')} AS rank FROM {ROWS}, t),
    f AS (SELECT *, greatest(0, rank - 5 * p) AS further FROM r)
    SELECT idx, CASE WHEN rank < 5 * p THEN rank % p ELSE {permuted_sql(SEED, 'kid', 'c/free', 'further', 'free')} % p END AS pidx FROM f"""
)
def fk_quota(spark, sf_dir):
    return assign.quota(rows(spark, sf_dir), count(spark, sf_dir, "customer"), 5, 15, SEED, "kid", "c").select("idx", "pidx")


def _ranks_sql(idx: str, total: str) -> str:
    """e: distinct ranks in [0, total)."""
    return f"""t AS (SELECT ({total})::BIGINT AS n), e AS (SELECT idx, {permuted_sql(SEED, "bridge", "rank/rank", "idx", "n")} AS rank FROM {idx}, t)"""


@query(f"WITH {_ranks_sql(ROWS, '(SELECT count(*) FROM customer) * (SELECT count(*) FROM part)')}, s AS (SELECT count(*) AS np FROM part) SELECT idx, rank // np AS c, rank % np AS p FROM e, s")
def bridge_pairs(spark, sf_dir):
    sizes = [count(spark, sf_dir, "customer"), count(spark, sf_dir, "part")]
    return assign.tuples(rows(spark, sf_dir), sizes, ["c", "p"], SEED, "bridge")


@query(
    f"""WITH {_ranks_sql(ROWS, '(SELECT count(*) FROM customer) * (SELECT count(*) FROM part) * (SELECT count(*) FROM supplier)')},
    s AS (SELECT (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns)
    SELECT idx, rank // (np * ns) AS c, rank // ns % np AS p, rank % ns AS s FROM e, s"""
)
def compound_tuples(spark, sf_dir):
    sizes = [count(spark, sf_dir, t) for t in ("customer", "part", "supplier")]
    return assign.tuples(rows(spark, sf_dir), sizes, ["c", "p", "s"], SEED, "bridge")


@query(
    f"""WITH n AS (SELECT (SELECT count(*) FROM orders) AS c, {N_CUSTOMER} AS l, (SELECT count(*) FROM part) AS r),
    e AS (SELECT idx, CASE WHEN idx < c % l * (c // l + 1) THEN idx // (c // l + 1) ELSE c % l + (idx - c % l * (c // l + 1)) // greatest(1, c // l) END AS lp, idx % r AS rp FROM {ROWS}, n),
    a AS (SELECT c_custkey AS lkey, row_number() OVER (ORDER BY {u('l', 'rank', 'c_custkey', 'bridge')}, c_custkey) - 1 AS lp FROM customer),
    b AS (SELECT p_partkey AS rkey, row_number() OVER (ORDER BY {u('r', 'rank', 'p_partkey', 'bridge')}, p_partkey) - 1 AS rp FROM part)
    SELECT idx, lkey, rkey FROM e JOIN a USING (lp) JOIN b USING (rp)"""
)
def bridge_quota(spark, sf_dir):
    left, right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lkey")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rkey"))
    pairs = assign.bounded_pairs(rows(spark, sf_dir), left.count(), right.count(), (1, 0), (100, 100), SEED, "bridge")
    left, right = numbered(left, [F.col("lkey")], "lpos"), numbered(right, [F.col("rkey")], "rpos")
    return pairs.join(left, "lpos").join(right, "rpos").select("idx", "lkey", "rkey")


def _tenant_sql(rows_: str, right: str = "SELECT s_nationkey AS nation FROM supplier") -> str:
    """Pairs of customers and others of their nation: nations in order of a draw, flat ranks unranked."""
    return f"""l AS (SELECT c_nationkey AS nation, count(*) AS l FROM customer GROUP BY 1), r AS (SELECT nation, count(*) AS r FROM ({right}) GROUP BY 1),
    b AS (SELECT nation, l, r, l * r AS w, {u('group', 'rank', 'nation', 'bridge')} AS h FROM l JOIN r USING (nation)),
    c AS (SELECT *, (sum(w) OVER (ORDER BY h, nation) - w)::BIGINT AS low, (sum(w) OVER (ORDER BY h, nation))::BIGINT AS high FROM b),
    {_ranks_sql(rows_, '(SELECT sum(w)::BIGINT FROM b)')},
    x AS (SELECT idx, nation, (rank - low) // r AS lpos, (rank - low) % r AS rpos FROM e JOIN c ON rank >= low AND rank < high)"""


@query(f"WITH {_tenant_sql('(SELECT s_suppkey AS idx FROM supplier)')} SELECT idx, nation, lpos, rpos FROM x")
def tenant_pairs(spark, sf_dir):
    """Distinct pairs within nations, as many as there are suppliers."""
    left = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    right = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return assign.group_pairs(left, right, ["nation"], count(spark, sf_dir, "supplier"), SEED, "bridge")


@query(
    f"""WITH {_tenant_sql('(SELECT c_custkey AS idx FROM customer)', 'SELECT c_nationkey AS nation FROM customer')},
    a AS (SELECT c_custkey AS k, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer)
    SELECT idx, x.nation, p.k AS giver, q.k AS taker FROM x JOIN a p ON x.nation = p.nation AND lpos = p.pos JOIN a q ON x.nation = q.nation AND rpos = q.pos"""
)
def tenant_bridge(spark, sf_dir):
    """A bridge whose two keys share the nation: distinct pairs of customers of one nation, as many as there are
    customers."""
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("k"))
    sizes = people.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
    pairs = assign.group_pairs(sizes, sizes, ["nation"], people.count(), SEED, "bridge")
    placed = assign.positions(people, ["nation"], ["k"]).drop("n")
    for pos, key in (("lpos", "giver"), ("rpos", "taker")):
        pairs = pairs.join(placed.withColumnsRenamed({"pos": pos, "k": key}), ["nation", pos])
    return pairs.select("idx", "nation", "giver", "taker")


@query(
    f"""WITH p AS (SELECT o_orderkey AS idx, c_nationkey AS nation, o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey),
    m AS (SELECT s_suppkey AS s, s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
    q AS (SELECT p.*, {pick_sql(u('s', 'fk', name='kid'), 'n')} AS pos FROM p LEFT JOIN (SELECT DISTINCT nation, n FROM m) USING (nation))
    SELECT idx, q.nation, c, s FROM q LEFT JOIN m ON q.nation = m.nation AND q.pos = m.pos"""
)
def tenant_shared_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("c"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("nation"))
    return assign.within_group(orders.join(customers, "c"), suppliers, ["nation"], ["s"], SEED, "kid", "s").select("idx", "nation", "c", "s")


# keys that share the nation: customers and suppliers, chosen for one row

_LABEL = {"c": "nation,c", "s": "nation,s"}


def _u_shared(tag: str, idx: str = "idx") -> str:
    return uniform_sql(SEED, "kid", tag, idx)


def _groups_sql(rule: str = "nc > 0 AND ns > 0") -> str:
    """g: nations with their members of each side, numbered in the order of a draw; c, s: members by place."""
    return f"""m AS (SELECT coalesce(a.nation, b.nation) AS nation, coalesce(nc, 0) AS nc, coalesce(ns, 0) AS ns FROM (SELECT c_nationkey AS nation, count(*) AS nc FROM customer GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS nation, count(*) AS ns FROM supplier GROUP BY 1) b USING (nation)),
    g AS (SELECT *, row_number() OVER (ORDER BY {_u_shared('group/rank', 'nation')}, nation) - 1 AS gid FROM m), ok AS (SELECT * FROM g WHERE {rule}),
    c AS (SELECT c_custkey AS c, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer),
    s AS (SELECT s_suppkey AS s, s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier)"""


def _level_sql(groups: str, low: str, high: str, total: str, name: str, tag: str, keep: str = "*", out: str = "x") -> str:
    """name: the groups with x rows each: the level at which the clamped intervals sum up to total, one more
    for the first by a draw."""
    clamp = f"greatest({low}, least({high}, v))"
    return f"""{name}_v AS (SELECT min(v) AS v FROM range((SELECT min({low}) FROM {groups})::BIGINT, 1 + (SELECT max({high}) FROM {groups})::BIGINT) t(v) WHERE (SELECT sum({clamp}) FROM {groups}) >= {total}),
    {name}_b AS (SELECT {keep}, greatest({low}, least({high}, v - 1))::BIGINT AS base, {low} <= v - 1 AND {high} >= v AS open FROM {groups}, {name}_v),
    {name} AS (SELECT * EXCLUDE (base, open, v), (base + (open AND row_number() OVER (PARTITION BY open ORDER BY {_u_shared(f"group/{tag}/rank", "gid")}, gid) <= {total} - (SELECT sum(base) FROM {name}_b))::INT)::BIGINT AS {out} FROM {name}_b)"""


def _sides(spark, sf_dir, c: dict, s: dict) -> list:
    parents = lambda name, key, nation, as_: table(spark, sf_dir, name).select(F.col(nation).alias("nation"), F.col(key).alias("pidx"), F.col(key).alias(as_))
    return [
        shared.Side(parents("customer", "c_custkey", "c_nationkey", "c"), _LABEL["c"], **c),
        shared.Side(parents("supplier", "s_suppkey", "s_nationkey", "s"), _LABEL["s"], **s),
    ]


@query(
    f"""WITH {_groups_sql()}, w AS (SELECT *, sum(nc) OVER (ORDER BY gid) - nc AS low, sum(nc) OVER (ORDER BY gid) AS high FROM ok),
    p AS (SELECT idx, {pick_sql(_u_shared('group/group'), '(SELECT sum(nc) FROM ok)')} AS spot FROM {ROWS}),
    x AS (SELECT idx, nation, {pick_sql(_u_shared('nation,c/fk'), 'nc')} AS cp, {pick_sql(_u_shared('nation,s/fk'), 'ns')} AS sp FROM p JOIN w ON spot >= low AND spot < high)
    SELECT idx, x.nation, c, s FROM x JOIN c ON c.nation = x.nation AND c.pos = cp JOIN s ON s.nation = x.nation AND s.pos = sp"""
)
def tenant_joint_groups(spark, sf_dir):
    """Rows draw a nation that has customers and suppliers, by its customers; then one of each."""
    orders = rows(spark, sf_dir)
    return shared.assigned(orders, orders.count(), _sides(spark, sf_dir, {}, {}), ["nation"], SEED, "kid").select("idx", "nation", "c", "s")


@query(
    f"""WITH {_groups_sql()}, n AS (SELECT (sum(nc) // 2)::BIGINT AS n FROM ok), o AS (SELECT *, (SELECT n FROM n) AS n FROM ok),
    {_level_sql("o", "ns", "least(nc, 40 * ns, n)", "(SELECT n FROM n)", "x", "a")},
    w AS (SELECT *, sum(x) OVER (ORDER BY gid) - x AS low, sum(x) OVER (ORDER BY gid) AS high FROM x),
    i AS (SELECT c_custkey AS idx, n FROM customer, n WHERE c_custkey < n), p AS (SELECT idx, {permuted_sql(SEED, 'kid', 'mask1/label', 'idx', 'n')} AS spot FROM i),
    r AS (SELECT idx, nation, nation::VARCHAR AS key, (spot - low)::BIGINT AS rank, nc, ns, x FROM p JOIN w ON spot >= low AND spot < high),
    q AS (SELECT *, {permuted_sql(SEED, 'kid', 'nation,s/child', 'rank', 'x', 'key')} AS sr FROM r),
    f AS (SELECT *, greatest(0, sr - ns) AS further, ns * 39 AS free FROM q),
    y AS (SELECT idx, nation, {permuted_sql(SEED, 'kid', 'nation,c/parent', 'rank', 'nc', 'key')} AS cp,
      CASE WHEN sr < ns THEN sr ELSE {permuted_sql(SEED, 'kid', 'nation,s/free', 'further', 'free', 'key')} % ns END AS sp FROM f)
    SELECT idx, y.nation, c, s FROM y JOIN c ON c.nation = y.nation AND c.pos = cp JOIN s ON s.nation = y.nation AND s.pos = sp"""
)
def tenant_joint_limits(spark, sf_dir):
    """Each customer at most once and each supplier 1 to 40 times, in rows whose two keys share the nation: half as
    many as there are customers in nations with suppliers."""
    sides = _sides(spark, sf_dir, {"strategy": "unique_subset"}, {"strategy": "quota", "low": 1, "high": 40})
    n = sides[0].members.join(sides[1].members, "nation", "left_semi").count() // 2
    return shared.assigned(spark.range(n).withColumnRenamed("id", "idx"), n, sides, ["nation"], SEED, "kid").select("idx", "nation", "c", "s")


@query(
    f"""WITH {_groups_sql("nc > 0")}, t AS (SELECT count(*) // 2 AS n FROM orders), o AS (SELECT *, nc AS low, least(20 * nc, 3 * ns + 5 * nc) AS high FROM ok),
    {_level_sql("o", "low", "high", "(SELECT n FROM t)", "x", "a")} SELECT nation, x FROM x"""
)
def group_apportionment(spark, sf_dir):
    """Half as many rows as there are orders over nations, each within its bounds, as even as these allow."""
    sides = _sides(spark, sf_dir, {}, {})
    groups = shared.group_table(sides, ["nation"], SEED, "kid").where("n0 > 0")
    low, high = F.col("n0"), F.least(F.col("n0") * 20, F.col("n1") * 3 + F.col("n0") * 5)
    draw = Cell(SEED, "kid", "group/a", F.col("gid")).u("rank")
    return shared.apportioned(groups, low, high, count(spark, sf_dir, "orders") // 2, draw, "x", "bounds").select("nation", "x")


@query(
    f"""WITH {_groups_sql("ns > 0")}, n AS (SELECT (SELECT count(*) FROM customer) // 2 AS n),
    i AS (SELECT c_custkey AS idx, n, ({_u_shared('nation,c/null', 'c_custkey')} >= 0.5) AS has FROM customer, n WHERE c_custkey < n),
    k AS (SELECT *, row_number() OVER (PARTITION BY has ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY has) AS size FROM i),
    tot AS (SELECT count(*) FILTER (has) AS w, count(*) FILTER (NOT has) AS b FROM i),
    o AS (SELECT *, 0 AS la, least(nc * 2, n) AS ha, ns AS lb, least(40 * ns, n) AS hb FROM ok, n),
    caps AS (SELECT *, least(lb, ha, hb) * 0 AS one, least(lb, least(ha, hb)) AS two, least(ha, hb) - least(lb, least(ha, hb)) AS three FROM o),
    need AS (SELECT least(sum(two), greatest(greatest(0, sum(lb) - (SELECT b FROM tot)), least(sum(two), (SELECT w FROM tot))))::BIGINT AS y2 FROM caps), y AS (SELECT y2, (SELECT w FROM tot) - y2 AS y3 FROM need),
    {_level_sql("caps", "0", "two", "(SELECT y2 FROM y)", "x2", "__two_a", out="w2")},
    {_level_sql("x2", "0", "three", "(SELECT y3 FROM y)", "x3", "__three", out="w3")},
    x AS (SELECT *, w2 + w3 AS w FROM x3),
    {_level_sql("x", "greatest(0, lb - w)", "(hb - w)", "(SELECT b FROM tot)", "z", "only_a", out="b")},
    cum AS (SELECT *, sum(w) OVER (ORDER BY gid) - w AS wl, sum(w) OVER (ORDER BY gid) AS wh, sum(b) OVER (ORDER BY gid) - b AS bl, sum(b) OVER (ORDER BY gid) AS bh, w + b AS alls FROM z),
    p AS (SELECT idx, has, CASE WHEN has THEN {permuted_sql(SEED, 'kid', 'mask3/label', 'k', 'size')} ELSE {permuted_sql(SEED, 'kid', 'mask1/label', 'k', 'size')} END AS spot FROM k),
    r AS (SELECT idx, has, nation, nation::VARCHAR AS key, nc, ns, w, alls, (CASE WHEN has THEN spot - wl ELSE w + spot - bl END)::BIGINT AS rank FROM p JOIN cum ON CASE WHEN has THEN spot >= wl AND spot < wh ELSE spot >= bl AND spot < bh END),
    f AS (SELECT *, {permuted_sql(SEED, 'kid', 'nation,s/child', 'rank', 'alls', 'key')} AS sr, CASE WHEN has THEN {permuted_sql(SEED, 'kid', 'nation,c/child', 'rank', 'w', 'key')} END AS cr, ns * 39 AS sfree, nc * 2 AS cfree FROM r),
    h AS (SELECT *, greatest(0, sr - ns) AS further FROM f),
    q AS (SELECT idx, nation, CASE WHEN has THEN {permuted_sql(SEED, 'kid', 'nation,c/free', 'cr', 'cfree', 'key')} % nc END AS cp,
      CASE WHEN sr < ns THEN sr ELSE {permuted_sql(SEED, 'kid', 'nation,s/free', 'further', 'sfree', 'key')} % ns END AS sp FROM h)
    SELECT idx, q.nation, c, s FROM q LEFT JOIN c ON c.nation = q.nation AND c.pos = cp JOIN s ON s.nation = q.nation AND s.pos = sp"""
)
def tenant_joint_nulls(spark, sf_dir):
    """A customer, at most twice, in half of the rows and a supplier, 1 to 40 times, in all: both of one nation."""
    n = count(spark, sf_dir, "customer") // 2
    sides = _sides(spark, sf_dir, {"strategy": "quota", "high": 2, "null_ratio": 0.5, "nullable": True}, {"strategy": "quota", "low": 1, "high": 40})
    return shared.assigned(spark.range(n).withColumnRenamed("id", "idx"), n, sides, ["nation"], SEED, "kid").select("idx", "nation", "c", "s")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def group_intersect(spark, sf_dir):
    return assign.shared_groups(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def distinct_projection(spark, sf_dir):
    return assign.first_of_projection(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"], "p_partkey")


@query("SELECT c_custkey AS idx, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS place FROM customer")
def dense_index(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), "c_acctbal")
    return numbered(customers, [F.col("c_acctbal"), F.col("idx")], "place").select("idx", "place")


@query(
    f"""WITH RECURSIVE l AS (SELECT 0 AS level, 0::BIGINT AS start, 1::BIGINT AS size UNION ALL SELECT level + 1, start + size, size * 4 FROM l WHERE start + size < {N_CUSTOMER}),
    s AS (SELECT level, start, least(size, {N_CUSTOMER} - start) AS size FROM l), r AS (SELECT c_custkey AS idx, level, start FROM customer, s WHERE c_custkey >= start AND c_custkey < start + size)
    SELECT idx, r.level, (s.start + {pick_sql(u('boss', 'fk', name='emp'), 's.size')}) AS parent_idx FROM r LEFT JOIN s ON s.level = r.level - 1"""
)
def self_ref_levels(spark, sf_dir):
    people = rows(spark, sf_dir, "customer", "c_custkey")
    return assign.leveled(people, people.count(), 4, SEED, "emp", "boss")


@query(
    f"""WITH m AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
    q AS (SELECT c_custkey AS idx, c_nationkey, {pick_sql(u('rep', 'fk', 'c_custkey', 'cyc'), 'n')} AS pos FROM customer LEFT JOIN (SELECT DISTINCT s_nationkey, n FROM m) ON c_nationkey = s_nationkey)
    SELECT idx, c_nationkey AS nation, s_suppkey AS rep FROM q LEFT JOIN m ON c_nationkey = s_nationkey AND q.pos = m.pos"""
)
def cycle_fill(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("nation"), F.lit(None).cast("long").alias("rep"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return assign.fill_cycle(left, right, ["nation"], ["s_suppkey"], "rep", "s_suppkey", SEED, "cyc").select("idx", "nation", "rep")


# rules

LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def lines(spark, sf_dir, columns, *parents):
    df = table(spark, sf_dir, "lineitem").select(*columns)
    return rules.with_parent(df, table(spark, sf_dir, "orders"), "l_orderkey", {"l_orderkey": "o_orderkey"}, list(parents))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) / o_totalprice * 100.0::DOUBLE AS share FROM {LINES}")
def rule_derivation(spark, sf_dir):
    rule = rules.Rule("share = l_extendedprice * (1 - l_discount) / parent(l_orderkey).o_totalprice * ref('percent')")
    df = lines(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"], *[c for _, c in rule.parents])
    return rules.evaluate(df, rule.column, rule.right, cell("share"), {"percent": 100.0}).select("l_orderkey", "l_linenumber", "l_partkey", F.col("share").cast("double").alias("share"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(l_shipdate::DATE, o_orderdate::DATE) AS ship FROM {LINES}")
def rule_bound(spark, sf_dir):
    rule = rules.Rule("ship >= date(parent(l_orderkey).o_orderdate)")
    df = lines(spark, sf_dir, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], *[c for _, c in rule.parents])
    df = rules.evaluate(df.withColumn("ship", F.to_date("l_shipdate")), "low", rule.right, cell("ship"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", g.bounded(F.col("ship"), low=F.col("low")).alias("ship"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM {LINES} WHERE NOT coalesce(l_shipdate >= o_orderdate, false)")
def rule_assertion_parent(spark, sf_dir):
    rule = rules.Rule("l_shipdate >= parent(l_orderkey).o_orderdate")
    df = lines(spark, sf_dir, LINE, *[c for _, c in rule.parents])
    sql, _ = rules.compile_text(rule.text, cell("l_shipdate"))
    checked = validate.with_issues(df, [validate.rule(F.expr(sql), ["l_shipdate"], rule.text)])
    return validate.quarantined(checked).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT o_orderkey AS idx, (o_orderkey % 7 + 1)::BIGINT AS c, (o_orderkey % 7 + 1) * 3 AS b, (o_orderkey % 7 + 1) * 3 + 2 AS a FROM orders")
def rule_chain(spark, sf_dir):
    """Rules that read each other's columns, written in the wrong order."""
    given = [rules.Rule("a = b + 2", 0), rules.Rule("b = c * 3", 1), rules.Rule("c = idx % 7 + 1", 2)]
    df = rows(spark, sf_dir)
    for rule in rules.ordered(given):
        df = rules.evaluate(df, rule.column, rule.right, cell(rule.column))
    return df.select("idx", *[F.col(c).cast("bigint").alias(c) for c in ("c", "b", "a")])


_DRAWN = "(round(o_totalprice)::BIGINT % 500)"


@query(
    f"""WITH x AS (SELECT o_orderkey AS idx, {_DRAWN} AS v, (o_custkey % 400)::BIGINT AS low FROM orders)
    SELECT idx, CASE WHEN v >= low THEN v ELSE low + least(floor({u('v', 'bound')} * (499 - low + 1)), 499 - low)::BIGINT END AS v FROM x"""
)
def rule_bound_redraw(spark, sf_dir):
    """Values under a bound of their row are drawn anew between it and the generator's edge."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.expr("cast(round(o_totalprice) as bigint) % 500").alias("v"), (F.col("o_custkey") % 400).cast("bigint").alias("low"))
    return df.select("idx", g.redrawn(cell("v"), F.col("v"), F.col("low"), ">=", 499, "integer").cast("bigint").alias("v"))


def _bounds_sql() -> str:
    out = f"""SELECT o_orderkey AS idx, o_totalprice % 400 AS v, greatest(20.0::DOUBLE + o_custkey % 50, 10) AS __lo, least(28.0::DOUBLE + o_custkey % 50 + o_custkey % 37, 300) AS __hi,
    {u("v", "bound", "o_orderkey")} + 1.1102230246251565e-16::DOUBLE AS __u FROM orders"""
    for name, text in g.truncated_steps("lognormal", math.log(60.0), 0.4):
        out = f"SELECT *, {text} AS {name} FROM ({out})"
    return f"SELECT idx, floor((CASE WHEN v >= __lo AND v <= __hi THEN v ELSE __new END) * 10000 + 0.5) / 10000 AS v, v >= __lo AND v <= __hi AS kept FROM ({out})"


@query(_bounds_sql())
def rule_two_bounds(spark, sf_dir):
    """Two bounds of each row and the generator's edges: a lognormal draw between them where the value isn't."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") % 400).alias("v"), (20 + F.col("o_custkey") % 50).alias("low"), (28 + F.col("o_custkey") % 50 + F.col("o_custkey") % 37).alias("high"))
    made = g.within_bounds(df, cell("v"), "v", [(F.col("low"), False), (F.lit(10.0), False)], [(F.col("high"), False), (F.lit(300.0), False)], None, g.shape_of("lognormal", {"low": 10, "high": 300, "median": 60.0, "sigma": 0.4}))
    return made.select("idx", g.rounded(F.col("__made"), 4).alias("v"), (F.col("__made") == F.col("v")).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 30000 OR l_quantity > 45")
def rule_recheck(spark, sf_dir):
    """Finished rows against their bounds: what is outside goes to quarantine."""
    df = table(spark, sf_dir, "lineitem").select(*LINE, "l_discount", "l_quantity")
    checks = [validate.rule(F.expr(rules.check_text(t)), [], t) for t in ("l_extendedprice * (1 - l_discount) <= 30000", "l_quantity <= 45")]
    return validate.quarantined(validate.with_issues(df, checks)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    f"""SELECT o_orderkey AS idx, date_part('year', o_orderdate)::INT - 1990 - CASE WHEN date_part('month', o_orderdate) * 100 + date_part('day', o_orderdate) < 615 THEN 1 ELSE 0 END AS years FROM orders"""
)
def rule_years_between(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_orderdate")
    return rules.evaluate(df, "years", "years_between(o_orderdate, date(1990, 6, 15))", cell("years")).select("idx", "years")


# validation


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::VARCHAR AS shipped FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) > 1")
def validate_unique(spark, sf_dir):
    found = validate.duplicates(table(spark, sf_dir, "lineitem").select(*LINE), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"))


@query("SELECT event_id, user_id FROM events WHERE user_id IS NOT NULL AND user_id * 20 NOT IN (SELECT c_custkey FROM customer)")
def validate_fk(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") * 20).alias("key"))
    return validate.orphans(events, table(spark, sf_dir, "customer"), ["key"], ["c_custkey"]).select("event_id", "user_id")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 40 OR p_size = 7 OR p_retailprice <= 1000")
def validate_check_bounds(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    checks = [validate.bounds("p_size", high=40, excluded=[7]), validate.bounds("p_retailprice", low=1000.0, low_exclusive=True)]
    return validate.quarantined(validate.with_issues(parts, checks)).drop("issues")


@query("SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END IS NULL) <> (o_orderstatus = 'F')")
def validate_match_full(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("a"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("b")
    )
    return validate.partly_null(orders, ["a", "b"]).select("o_orderkey")


BROKEN = "(o_totalprice > 400000)::INT + (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW'))::INT + (o_orderstatus = 'P' AND o_totalprice < 1000)::INT"


def _checked_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    checks = [
        validate.bounds("o_totalprice", high=400000.0),
        validate.bounds("o_orderpriority", values=["1-URGENT", "2-HIGH", "5-LOW"]),
        validate.check("NOT (o_orderstatus = 'P' AND o_totalprice < 1000)", ["o_orderstatus", "o_totalprice"]),
    ]
    return validate.with_issues(orders, checks)


@query(f"SELECT o_orderkey, ({BROKEN})::INT AS n_issues FROM orders")
def quarantine_split(spark, sf_dir):
    checked = _checked_orders(spark, sf_dir)
    bad = validate.quarantined(checked).select("o_orderkey", F.size("issues").alias("n_issues"))
    return bad.unionByName(validate.accepted(checked).select("o_orderkey", F.lit(0).alias("n_issues")))


@query(
    f"""WITH q AS (SELECT 'orders' AS "table", o_orderkey AS k, CASE WHEN o_totalprice > 400000 OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'out of bounds' ELSE 'check NOT (o_orderstatus = ''P'' AND o_totalprice < 1000)' END AS reason FROM orders WHERE {BROKEN} > 0
    UNION ALL SELECT 'part', p_partkey, 'out of bounds' FROM part WHERE p_size > 40)
    SELECT "table", count(*) AS "rows", arg_min(reason, k) AS first_reason FROM q GROUP BY 1"""
)
def quarantine_summary(spark, sf_dir):
    parts = validate.with_issues(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o_orderkey"), "p_size"), [validate.bounds("p_size", high=40)])
    return validate.quarantine_summary({"orders": validate.quarantined(_checked_orders(spark, sf_dir)), "part": validate.quarantined(parts)}, "o_orderkey")


@query(
    """WITH c AS (SELECT * FROM customer WHERE c_acctbal >= 0), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
    SELECT 'customer' AS t, count(*) AS n, sum(c_custkey)::BIGINT AS k FROM c UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM l"""
)
def ri_closure(spark, sf_dir):
    tables = {
        "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").where("c_acctbal >= 0"),
        "orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
        "lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"),
    }
    keys = [("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ("orders", ["o_custkey"], "customer", ["c_custkey"])]
    kept = validate.closure(tables, keys)
    parts = [kept[t].agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k")).select(F.lit(t).alias("t"), "n", "k") for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _rounds_sql(rounds: int = 12) -> str:
    """Proposals round by round: of a value nobody has, the first row wins; so many rounds leave none."""
    parts = ["r0 AS (SELECT c_custkey AS idx FROM customer), taken0 AS (SELECT 0::BIGINT AS idx, 0::BIGINT AS code WHERE false)"]
    for k in range(rounds):
        draw = pick_sql(u("code", f"try{k}"), f"4 * {N_CUSTOMER}")
        parts.append(f"p{k} AS MATERIALIZED (SELECT idx, {draw} AS code FROM r{k}), w{k} AS MATERIALIZED (SELECT min(idx) AS idx, code FROM p{k} WHERE code NOT IN (SELECT code FROM taken{k}) GROUP BY code)")
        parts.append(f"taken{k + 1} AS MATERIALIZED (SELECT idx, code FROM taken{k} UNION ALL SELECT idx, code FROM w{k}), r{k + 1} AS (SELECT idx FROM r{k} WHERE idx NOT IN (SELECT idx FROM w{k}))")
    return f"WITH {', '.join(parts)} SELECT idx, code FROM taken{rounds}"


@query(_rounds_sql())
def unique_iterative(spark, sf_dir):
    people = rows(spark, sf_dir, "customer", "c_custkey")
    n = people.count()
    return validate.distinct_values(people, lambda k: pick(cell("code").u(f"try{k}"), 4 * n), "code", "idx")


@query("SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')")
def enum_except(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("v"))
    return values.where(~F.col("v").isin("5-LOW", "4-NOT SPECIFIED")).distinct()


# reports


@query(
    """SELECT source, count(*) AS n, avg(quality)::DOUBLE AS quality_rate, sum(toxic)::BIGINT AS toxic, avg(n_chars)::DOUBLE AS mean_chars
    FROM documents JOIN labels USING (doc_id) GROUP BY source"""
)
def metric_group_rates(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return reports.group_rates(joined, ["source"], {"quality_rate": "quality"}, {"toxic": "toxic"}, {"mean_chars": "n_chars"})


@query(
    """WITH x AS (SELECT event_type, user_id, count(DISTINCT floor(value)) AS d, count(*) AS c FROM events GROUP BY ALL)
    SELECT event_type, count(*) AS n, avg((d = 1)::INT)::DOUBLE AS stable_share FROM x WHERE c >= 2 GROUP BY 1"""
)
def metric_stability(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "user_id", F.floor("value").alias("v"))
    return reports.stability(events, ["event_type"], ["user_id"], ["v"])


@query(
    """WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ('the', 'of'))) AS k FROM part)
    SELECT p_partkey, len(k)::INT AS n, list_has_any(k, ['brass', 'steel', 'large']) AS hit FROM w"""
)
def metric_keywords(spark, sf_dir):
    k = reports.keywords(F.col("p_type"), ["the", "of"])
    return table(spark, sf_dir, "part").select("p_partkey", F.size(k).alias("n"), F.arrays_overlap(k, F.array(*map(F.lit, ["brass", "steel", "large"]))).alias("hit"))


@query(
    """WITH e AS (SELECT *, event_id // 20 AS run, (props->>'k')::BIGINT AS k FROM events),
    r AS (SELECT run, 'm' || (run % 5) AS model, run % 7 <> 0 AS ok, run % 11 = 0 AS broken, sum(value) AS latency FROM e GROUP BY ALL),
    x AS (SELECT r.model, CASE WHEN l.toxic = 1 THEN k % 3 = 2 ELSE k % 3 < 2 END AS g, CASE WHEN l.quality = 1 THEN k % 2 = 0 END AS ro, CASE WHEN l.quality = 0 AND k % 4 > 0 THEN value / 100 < 0.6 END AS c
      FROM e JOIN r USING (run) JOIN labels l ON l.doc_id = e.k WHERE ok AND NOT broken)
    SELECT model, calls, valid, generator_hits, generator_total, role_hits, role_total, calibration_hits, calibration_total FROM
    (SELECT model, count(*) AS calls, count(*) FILTER (ok) AS valid FROM r GROUP BY 1) JOIN
    (SELECT model, count(*) FILTER (g) AS generator_hits, count(g) AS generator_total, count(*) FILTER (ro) AS role_hits, count(ro) AS role_total, count(*) FILTER (c) AS calibration_hits, count(c) AS calibration_total FROM x GROUP BY 1) USING (model)"""
)
def metric_answer_scores(spark, sf_dir):
    """Twenty events make up a run's answer, as JSON text that is parsed again; rows of `labels` say what is right."""
    events = table(spark, sf_dir, "events").withColumn("run", F.expr("event_id div 20")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    column = F.struct(
        F.col("k").cast("string").alias("column_name"),
        F.when(F.col("k") % 2 == 0, "the number of an Item").otherwise("other things").alias("semantic_role"),
        F.struct(F.element_at(F.array(*map(F.lit, "abc")), (F.col("k") % 3 + 1).cast("int")).alias("type")).alias("generator"),
        F.when(F.col("k") % 4 > 0, F.col("value") / 100).alias("confidence"),
    )
    tables = events.groupBy("run", "event_type").agg(F.struct(F.col("event_type").alias("table_name"), F.collect_list(column).alias("columns")).alias("t"), F.sum("value").alias("latency"))
    runs = tables.groupBy("run").agg(F.to_json(F.struct(F.collect_list("t").alias("tables"))).alias("raw_content"), F.sum("latency").alias("latency"))
    runs = runs.withColumns({"model": F.concat(F.lit("m"), (F.col("run") % 5).cast("string")), "fixture": F.lit("f"), "schema_valid": F.col("run") % 7 != 0})
    runs = runs.withColumn("raw_content", F.when(F.col("run") % 11 == 0, "not JSON").otherwise(F.col("raw_content")))
    kinds = F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))))
    labels = table(spark, sf_dir, "labels").select(
        F.lit("f").alias("fixture"), kinds.alias("table"), F.col("doc_id").cast("string").alias("column"), F.when(F.col("quality") == 1, "item").otherwise("desconocido").alias("role"),
        F.when(F.col("toxic") == 1, F.array(F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("acceptable"), (F.col("quality") == 0).alias("low_expected"),
    )
    found = reports.scored(runs, labels, ["fixture", "model"], ["the", "of", "an"])
    return reports.score_rates(runs, found, ["model"]).drop("latency")


@query("SELECT p_brand, p_type, count(*) AS n, sum(p_retailprice > 1500)::BIGINT AS dear FROM part GROUP BY ALL")
def metric_detail(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_retailprice") > 1500).alias("dear"))


# sinks


@query(
    """SELECT o_orderkey, CASE WHEN regexp_matches(t, '[,"\n\r]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS text_cell, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS bool_cell,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_cell
    FROM (SELECT *, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ', "x"' ELSE '' END AS t FROM orders)"""
)
def emit_csv_cells(spark, sf_dir):
    text = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, ', "x"').otherwise(""))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"), (F.col("o_orderkey") % 2 == 0).alias("b"), F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("d"))
    return orders.select("o_orderkey", *[cells.csv_cell(orders.schema[c]).alias(n) for c, n in (("t", "text_cell"), ("b", "bool_cell"), ("d", "date_cell"))])


@query(
    """SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''''') || '''' AS text_lit, CASE WHEN c_nationkey = 3 THEN 'NULL' ELSE c_nationkey::VARCHAR END AS int_lit,
    CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS bool_lit,
    '''{' || c_nationkey || ',"a b",NULL,"NULL","' || replace(c_mktsegment || '"', '"', '\\"') || '"}''' AS array_lit FROM customer"""
)
def emit_sql_literals(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat("c_name", F.lit("'s")).alias("t"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("i"),
        (F.col("c_acctbal") > 0).alias("b"),
        F.array(F.col("c_nationkey").cast("string"), F.lit("a b"), F.lit(None), F.lit("NULL"), F.concat("c_mktsegment", F.lit('"'))).alias("a"),
    )
    return customers.select("c_custkey", *[cells.sql_literal(customers.schema[c]).alias(n) for c, n in (("t", "text_lit"), ("i", "int_lit"), ("b", "bool_lit"), ("a", "array_lit"))])


@query(
    """WITH r AS (SELECT s_suppkey // 40 AS batch, s_suppkey, '(' || s_suppkey || ', ''' || s_name || ''', ' || s_nationkey || ')' AS t FROM supplier)
    SELECT batch, 'INSERT INTO supplier (s_suppkey, s_name, s_nationkey) VALUES\n  ' || string_agg(t, ',\n  ' ORDER BY s_suppkey) || ';' AS statement FROM r GROUP BY batch"""
)
def emit_insert_batches(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return cells.insert_statements(suppliers, "supplier", ["s_suppkey", "s_name", "s_nationkey"], "s_suppkey", 40)


@query("SELECT 'UPDATE customer SET rep = ' || c_nationkey || ' WHERE c_custkey = ' || c_custkey || ';' AS statement FROM customer WHERE c_nationkey <> 0")
def emit_updates(spark, sf_dir):
    filled = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") != 0, F.col("c_nationkey")).alias("rep"))
    return cells.update_statements(filled, "customer", ["c_custkey"], ["rep"])


@query(
    """SELECT 'orders' AS t, min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) AS contiguous FROM orders
    UNION ALL SELECT 'open orders', min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) FROM orders WHERE o_orderstatus = 'O'"""
)
def serial_guard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    whole = cells.contiguous(orders, "o_orderkey", 0).select(F.lit("orders").alias("t"), "contiguous")
    return whole.unionByName(cells.contiguous(orders.where("o_orderstatus = 'O'"), "o_orderkey", 0).select(F.lit("open orders").alias("t"), "contiguous"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_top10(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query(
    f"""WITH p AS (SELECT idx, {pick_sql(u('order_id', 'fk', name='payments'), '(SELECT count(*) FROM orders)')} AS order_id, (100 + {pick_sql(u('amount', name='payments'), 99901)}) / 100.0::DOUBLE AS amount,
    (DATE '1995-01-01' + {pick_sql(u('paid', name='payments'), 3654)}::INT)::DATE AS drawn FROM {ROWS})
    SELECT idx, order_id, amount, greatest(drawn, o_orderdate::DATE) AS paid FROM p JOIN orders ON order_id = o_orderkey WHERE amount <= o_totalprice"""
)
def synth_payments(spark, sf_dir):
    """Payments for existing orders: keys by arithmetic, a date bounded by the parent's, and only rows
    that satisfy a rule on the parent."""
    orders = table(spark, sf_dir, "orders")
    paid = Cell(SEED, "payments", "paid", F.col("idx"))
    made = assign.uniform(rows(spark, sf_dir), orders.count(), SEED, "payments", "order_id").withColumnRenamed("pidx", "order_id")
    made = made.withColumn("amount", g.numeric_range(Cell(SEED, "payments", "amount", F.col("idx")), 1, 1000, 2).cast("double"))
    made = rules.with_parent(made, orders, "order_id", {"order_id": "o_orderkey"}, ["o_orderdate", "o_totalprice"])
    low = F.to_date(rules.parent_column("order_id", "o_orderdate"))
    made = made.withColumn("paid", g.bounded(g.date_range(paid, dt.date(1995, 1, 1), dt.date(2005, 1, 1)), low=low))
    rule = rules.Rule("amount <= parent(order_id).o_totalprice")
    checked = validate.with_issues(made, [validate.rule(F.expr(rules.compile_text(rule.text, paid)[0]), ["amount"], rule.text)])
    return validate.accepted(checked).select("idx", "order_id", "amount", "paid")


@query("SELECT o_orderkey AS idx, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def group_positions(spark, sf_dir):
    """The free column of a compound key: a row's number within the rest of the key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_custkey")
    return assign.positions(orders, ["o_custkey"], ["idx"]).select("idx", "o_custkey", "pos", "n")


@query("SELECT p_partkey AS idx, (sum(p_size) OVER (ORDER BY p_partkey))::BIGINT AS high, (sum(p_size) OVER (ORDER BY p_partkey) - p_size)::BIGINT AS low FROM part")
def cumulative_weights(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("bigint").alias("w"))
    return cumulative(parts, "w", "idx").select("idx", "high", "low")


@query(
    f"""SELECT idx, floor(o_totalprice * (1 + 0.1::DOUBLE * (sqrt(-2 * ln(1 - {u('price', 'noise0.r', name='gen')})) * cos(2 * pi() * {u('price', 'noise0.t', name='gen')}))) * 100 + 0.5) / 100 AS price
    FROM (SELECT o_orderkey AS idx, o_totalprice FROM orders)"""
)
def rule_noise(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_totalprice")
    out = rules.evaluate(orders, "price", "o_totalprice * noise(0.1)", cell("price"))
    return out.select("idx", g.rounded(F.col("price"), 2).alias("price"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderkey::VARCHAR END AS t FROM orders WHERE o_orderkey % 7 = 0 OR length(o_orderkey::VARCHAR) > 4")
def validate_types(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderkey").cast("string"))
    rows_ = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return validate.quarantined(validate.with_issues(rows_, [validate.castable("t", "int"), validate.width("t", 4)])).drop("issues")


@query(
    """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","total":"' || total || '","odd":' || CASE WHEN o_orderkey % 2 = 1 THEN '"odd"' ELSE 'null' END || '}' AS line
    FROM (SELECT *, o_totalprice::DECIMAL(12,2)::VARCHAR AS total FROM orders)"""
)
def emit_json_objects(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("total"), F.when(F.col("o_orderkey") % 2 == 1, "odd").alias("odd"))
    return orders.select("o_orderkey", cells.json_object(orders, orders.columns).alias("line"))
