"""Constructs of the reference's SQL dialect in Spark's terms: sets, chains, JSON, digests, time zones, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import calibration, identity
from tessera.operators.views import local_date, minutes
from tessera.plans.tables import table

KEY = b"a key for tests"


def intersected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that every one of three features finds: urgent orders, a balance, a large order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    found = [o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), c.where("c_acctbal > 0").select("c_custkey"), o.where("o_totalprice > 200000").select("o_custkey")]
    return found[0].intersect(found[1]).intersect(found[2])


INTERSECTED = "select o_custkey k from orders join customer on c_custkey = o_custkey where c_acctbal > 0 group by 1 having count(*) filter (where o_orderpriority = '1-URGENT') > 0 and count(*) filter (where o_totalprice > 200000) > 0"


def successor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers succeeded by the next one, in chains of up to 64 and a ring."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k == 3, 1).when((k % 64 != 0) & (k % 100 != 5), k + 1).cast("long").alias("successor"))
    return identity.canonical_ids(c)


CHAINS = """with recursive s as (select c_custkey id, case when c_custkey = 3 then 1 when c_custkey % 64 <> 0 and c_custkey % 100 <> 5 then c_custkey + 1 end nxt from customer),
r as (select id, id cur, 0 hops from s union all select r.id, s.nxt, hops + 1 from r join s on s.id = r.cur where s.nxt is not null and hops < 31)
select r.id, case when s.nxt is null then r.cur end canonical from r left join s on s.id = r.cur qualify row_number() over (partition by r.id order by hops desc) = 1"""


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property k of events out of their JSON, gathered by user into a list and a JSON object again."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.from_json("props", "k int").k.alias("k"))
    each = e.groupBy("user_id", "event_type").agg(F.sum("k").alias("k"))
    return each.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "k"))))).alias("sums"))


JSON = """with e as (select user_id, event_type t, sum(cast(json_extract(props, '$.k') as int)) k from events group by 1, 2)
select user_id, string_agg(t, ',' order by t) types, '{' || string_agg('"' || t || '":' || k, ',' order by t) || '}' sums from e group by 1"""


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.sha256_utf16(F.col("c_name")).alias("utf16"), hashing.pseudonym(F.col("c_name"), KEY).alias("pseudonym"))


_PAD = lambda x: "".join(f"{b ^ x:02X}" for b in KEY.ljust(hashing.BLOCK, b"\0"))
DIGESTS = f"select c_custkey, sha256(unhex(regexp_replace(hex(c_name), '(..)', '\\100', 'g'))) utf16, sha256(unhex('{_PAD(0x5C)}' || sha256(unhex('{_PAD(0x36)}' || hex(c_name))))) pseudonym from customer"


def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their local day, and the boundaries of minutes and days to the user's event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w)).withColumn("local_day", local_date(F.col("ts")))
    return e.groupBy(F.col("local_day").cast("string").alias("local_day")).agg(F.count("*").alias("n"), F.sum(minutes("before", "ts")).alias("minute_boundaries"), F.sum(F.datediff("local_day", local_date(F.col("before")))).alias("day_boundaries"))


LOCAL = """with e as (select ts, lag(ts) over (partition by user_id order by ts, event_id) b, cast(ts::timestamp at time zone 'UTC' at time zone 'America/Sao_Paulo' as date) d from events)
select cast(d as varchar) local_day, count(*) n, sum(date_diff('minute', b, ts))::bigint minute_boundaries, sum(date_diff('day', cast(b::timestamp at time zone 'UTC' at time zone 'America/Sao_Paulo' as date), d))::bigint day_boundaries from e group by 1"""


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What managers ask of one another, against restrictions of all four forms."""
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 5).alias("owner"), F.when(k % 11 != 0, k % 7).alias("consumer"), F.when(k % 3 == 0, "ATRIBUTO_PESSOA").otherwise("BENEFICIO").alias("kind"), F.when(k % 4 == 0, "ENDERECO_CASA_ABRIGO_SIGILOSA").when(k % 4 == 1, "A").otherwise("B").alias("code"))
    rows = [(1, None, "BENEFICIO", None, "ATIVA", None), (2, 3, "BENEFICIO", None, "ATIVA", None), (3, None, "BENEFICIO", "A", "ATIVA", None), (4, 6, "ATRIBUTO_PESSOA", "B", "ATIVA", None), (0, None, "BENEFICIO", None, "ENCERRADA", None), (4, None, "BENEFICIO", None, "ATIVA", "2020-01-01")]
    bars = spark.createDataFrame([(*r[:5], "2019-01-01", r[5]) for r in rows], "owner long, consumer long, kind string, code string, status string, starts string, ends string")
    return identity.permitted(asked, bars, F.lit("2024-01-01")).groupBy("owner", "kind", "code", "permitted").agg(F.count("*").alias("n"))


PROJECTIONS = """with a as (select o_orderkey % 5 o, case when o_orderkey % 11 <> 0 then o_orderkey % 7 end c, case when o_orderkey % 3 = 0 then 'ATRIBUTO_PESSOA' else 'BENEFICIO' end kind, case o_orderkey % 4 when 0 then 'ENDERECO_CASA_ABRIGO_SIGILOSA' when 1 then 'A' else 'B' end code from orders)
select o as owner, kind, code, c is not null and not (kind = 'ATRIBUTO_PESSOA' and code like 'ENDERECO%' and o <> c) and not (kind = 'BENEFICIO' and (o = 1 or o = 2 and c = 3 or o = 3 and code = 'A')) and not (o = 4 and c = 6 and kind = 'ATRIBUTO_PESSOA' and code = 'B') permitted, count(*) n from a group by 1, 2, 3, 4"""


def guarded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of order priorities among finished and other orders, in the order of their ratios, read through the guard."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((F.count_if(F.expr("o_orderstatus = 'F'")) + 1).alias("m"), (F.count_if(F.expr("o_orderstatus <> 'F'")) + 1).alias("u"))
    placed = o.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("m") / F.col("u")), "o_orderpriority"))).withColumn("g", F.lit(1))
    return calibration.checked_ratios(placed, ["g"]).select("o_orderpriority", "place", "m", "u")


GUARD = "with o as (select o_orderpriority, count(*) filter (where o_orderstatus = 'F') + 1 m, count(*) filter (where o_orderstatus <> 'F') + 1 u from orders group by 1) select o_orderpriority, row_number() over (order by m / u desc, o_orderpriority) place, m, u from o"

_QUERIES = {
    "intersected_features": (intersected_features, INTERSECTED), "successor_chains": (successor_chains, CHAINS), "json_round_trip": (json_round_trip, JSON), "digests": (digests, DIGESTS), "local_days": (local_days, LOCAL),
    "projections": (projections, PROJECTIONS), "guarded_ratios": (guarded_ratios, GUARD),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items()}
