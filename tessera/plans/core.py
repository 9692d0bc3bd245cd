"""Analytic views and state operators in SQL that Spark and the second engine both read; {name} stands for a table.

Money is summed as DECIMAL, so results do not depend on the order of rows.
"""

from __future__ import annotations

import re

from tessera.plans.tables import run_sql

MONEY = "decimal(18,2)"

#: query -> SQL for Spark; the other engine's text differs only by DIALECT.
SQL = {
    # every sequence number from 1 to n, and every item done
    "delivery_completeness": """
        select l_orderkey, count(*) as items, min(l_linenumber) as first_seq, max(l_linenumber) as last_seq,
          case when min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) and sum(case when l_linestatus = 'F' then 1 else 0 end) = count(*) then 1 else 0 end as complete
        from {lineitem} group by l_orderkey""",
    "sla_lateness": """
        with x as (select o.o_orderkey, o.o_orderpriority, max(datediff(cast(l_shipdate as date), cast(o_orderdate as date))) as took,
            max(case when o_orderpriority like '1%' then 30 when o_orderpriority like '2%' then 60 else 90 end) as allowed
          from {orders} o join {lineitem} l on o.o_orderkey = l.l_orderkey group by o.o_orderkey, o.o_orderpriority)
        select o_orderpriority, case when took is null then 'SEM_MARCO' when took < 0 then 'DATA_FUTURA' when took <= allowed then 'NO_PRAZO' else 'EM_ATRASO' end as status,
          case when took is null then 'SEM_MARCO' when took < 0 then 'DATA_FUTURA' when took <= allowed then 'NO_PRAZO' when took - allowed <= 3 then '1-3_DIAS' when took - allowed <= 7 then '4-7_DIAS' when took - allowed <= 30 then '8-30_DIAS' else '31+_DIAS' end as band, count(*) as orders
        from x group by 1, 2, 3""",
    "lateness_p95": """
        select o_orderpriority, percentile(cast(datediff(cast(l_shipdate as date), cast(o_orderdate as date)) as double), 0.95) as p95, avg(cast(datediff(cast(l_shipdate as date), cast(o_orderdate as date)) as double)) as mean_days
        from {orders} join {lineitem} on o_orderkey = l_orderkey group by o_orderpriority""",
    "best_row_survivorship": """
        select o_custkey, o_orderkey, o_orderstatus, o_orderpriority from (
          select *, row_number() over (partition by o_custkey order by case when o_orderstatus = 'F' then 0 else 1 end, o_orderdate desc, o_totalprice desc, o_orderkey desc) as rn from {orders}) x where rn = 1""",
    "golden_record": """
        with f as (select o_custkey, o_orderpriority, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from {orders}),
        g as (select o_custkey, max(case when rn = 1 then o_orderpriority end) as priority, count(distinct o_orderpriority) as n_priority, max(case when rn = 1 then o_orderstatus end) as status, count(distinct o_orderstatus) as n_status, count(*) as n from f group by o_custkey)
        select c_custkey, c_name, priority, status, case when g.n is null then 'ABSENT' when n_priority > 1 then 'DIVERGENT' when g.n > 1 then 'CONFIRMED' else 'BASELINE' end as priority_state,
          case when g.n is null then 'ABSENT' when n_status > 1 then 'DIVERGENT' when g.n > 1 then 'CONFIRMED' else 'BASELINE' end as status_state,
          case when g.n is null then 'PARTIAL' else 'COMPLETE' end as core_state
        from {customer} left join g on c_custkey = o_custkey""",
    "current_link": """
        with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from {orders} where o_orderstatus <> 'F'),
        d as (select o_custkey, min(o_orderkey) as o_orderkey from {orders} where o_orderstatus = 'F' group by o_custkey)
        select o_custkey, o_orderkey, 'GOVERNED' as method from d
        union all select r.o_custkey, r.o_orderkey, 'RANKED' as method from r left join d on r.o_custkey = d.o_custkey where rn = 1 and d.o_custkey is null""",
    "distinct_by_scope": """
        select 'TOTAL' as scope, cast(null as string) as grp, count(distinct o_custkey) as people from {orders}
        union all select 'GROUP' as scope, c_mktsegment as grp, count(distinct o_custkey) as people from {orders} join {customer} on o_custkey = c_custkey group by c_mktsegment""",
    "quality_flags": """
        select l_returnflag, count(*) as n, sum(case when l_discount > 0.05 then 1 else 0 end) as deep_discount, sum(case when l_tax = 0 then 1 else 0 end) as untaxed,
          sum(case when l_shipdate is null then 1 else 0 end) as undated, max(case when l_quantity > 49 then 3 when l_quantity > 25 then 2 else 1 end) as worst
        from {lineitem} group by l_returnflag""",
    "send_quality": """
        with detail as (select o_orderpriority as p, case when o_orderstatus = 'F' then 1 else 0 end as ok, 1 as n from {orders} union all select o_orderpriority, 0, 0 from {orders})
        select p, sum(n) as sent, sum(ok) as accepted, case when sum(n) = 0 then null else cast(sum(ok) as double) / sum(n) end as rate from detail group by p""",
    "pending_ageing": """
        with x as (select o_orderkey, datediff((select max(cast(o_orderdate as date)) from {orders}), cast(o_orderdate as date)) as age from {orders} where o_orderstatus <> 'F')
        select case when age <= 30 then '0-30' when age <= 90 then '31-90' when age <= 180 then '91-180' when age <= 365 then '181-365' else '365+' end as bucket, count(*) as pending, min(age) as youngest, max(age) as oldest from x group by 1""",
    "hourly_throughput": """
        select cast(date_trunc('hour', ts) as string) as hour, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from {events} group by 1, 2""",
    "week_growth": """
        with w as (select cast(date_trunc('week', ts) as date) as week, count(*) as n from {events} group by 1), g as (select week, n, lag(n) over (order by week) as before, lag(week) over (order by week) as week_before from w)
        select cast(week as string) as week, n, case when datediff(week, week_before) = 7 then n - before end as growth from g""",
    "running_weights": """
        select n_nationkey, n_name, sum(n) over (order by n_nationkey rows between unbounded preceding and current row) as running from (select n_nationkey, n_name, count(c_custkey) as n from {nation} left join {customer} on n_nationkey = c_nationkey group by 1, 2) x""",
    "parameter_pivot": """
        select user_id, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'view' then value end) as view_, max(case when event_type = 'purchase' then value end) as purchase, count(*) as n from {events} group by user_id""",
    "idempotent_redelivery": """
        with h as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from {events})
        select user_id, count(*) as received, sum(case when before = event_type then 1 else 0 end) as redelivered, sum(case when before is null or before <> event_type then 1 else 0 end) as versions from h group by user_id""",
    "version_intervals": """
        with h as (select user_id, event_id, event_type, ts, lag(event_type) over (partition by user_id order by ts, event_id) as before from {events}),
        v as (select user_id, event_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) as version, lead(event_id) over (partition by user_id order by ts, event_id) as next_id from h where before is null or before <> event_type)
        select user_id, event_id, event_type, version, next_id, case when next_id is null then 'CURRENT' else 'HISTORIC' end as status from v""",
    "duplicate_alert": """
        select e.event_id, g.twin from {events} e join (select user_id, event_type, props, min(event_id) as twin from {events} group by user_id, event_type, props) g
        on e.user_id = g.user_id and e.event_type is not distinct from g.event_type and e.props is not distinct from g.props where g.twin < e.event_id""",
    "retification_conflict": """
        select a.l_orderkey, a.l_linenumber, concat_ws(',', case when a.l_returnflag <> b.l_returnflag then 'KIND' end, case when a.l_suppkey <> b.l_suppkey then 'PERSON' end, case when a.l_shipdate <> b.l_shipdate then 'START' end) as reasons
        from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber + 1""",
    "contract_qc": """
        select rule, count(*) as n from (select case when l_shipdate is null then 'R1_NO_DATE' when l_quantity <= 0 then 'R2_QUANTITY' when l_discount > 0.09 then 'R3_DISCOUNT' when l_extendedprice < 1000 then 'R4_VALUE' when l_tax > 0.07 then 'R5_TAX' else 'VALID' end as rule from {lineitem}) x group by rule""",
    "unambiguous_mapping": """
        select c_mktsegment, count(*) as n from {customer} left semi join (select o_custkey from {orders} group by o_custkey having count(distinct o_orderpriority) = 1) u on c_custkey = o_custkey group by c_mktsegment""",
    "no_orders_anti": """
        select c_nationkey, count(*) as n from {customer} left anti join {orders} on c_custkey = o_custkey group by c_nationkey""",
    "eligibility_rules": """
        select status, count(*) as n from (select case when o.n is null then 'NOT_EVALUABLE' when o.n < 3 then 'NOT_COMPATIBLE' when c_acctbal is null then 'NOT_EVALUABLE' when not (c_acctbal >= 0) then 'NOT_COMPATIBLE'
            when c_mktsegment in ('BUILDING', 'MACHINERY') or o.top >= 100000 then 'COMPATIBLE' else 'NOT_COMPATIBLE' end as status
          from {customer} left join (select o_custkey, count(*) as n, max(o_totalprice) as top from {orders} group by o_custkey) o on c_custkey = o_custkey) x group by status""",
    "rule_impact": """
        with v as (select case when c_acctbal >= 0 then 1 else 0 end as a, case when c_acctbal >= 1000 or c_mktsegment = 'BUILDING' then 1 else 0 end as b from {customer})
        select sum(case when a = 0 and b = 1 then 1 else 0 end) as entered, sum(case when a = 1 and b = 0 then 1 else 0 end) as left_, sum(a * b) as stayed, count(*) as total from v""",
    "name_frequency": """
        select p_brand, p_type, count(*) as n, cast(count(*) as double) / sum(count(*)) over (partition by p_brand) as share from {part} group by p_brand, p_type""",
    "shared_identifier": """
        with s as (select l_partkey, count(distinct l_suppkey) as holders, count(*) as n from {lineitem} group by l_partkey)
        select case when holders > 4 then 'SHARED_MANY' when holders > 1 then 'SHARED' else 'SINGLE' end as class, count(*) as parts, sum(n) as facts from s group by 1""",
    "grouping_totals": """
        select coalesce(n_name, 'ALL') as nation, count(*) as customers, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as balance from {customer} join {nation} on c_nationkey = n_nationkey group by grouping sets ((), (n_name))""",
    "wide_facts": """
        select r_name, n_name, l_returnflag, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value, count(distinct o_custkey) as people
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by r_name, n_name, l_returnflag""",
    "fan_out_census": """
        with d as (select l_partkey, count(distinct l_orderkey) as degree from {lineitem} group by l_partkey)
        select percentile(cast(degree as double), 0.5) as p50, percentile(cast(degree as double), 0.95) as p95, percentile(cast(degree as double), 0.99) as p99, max(degree) as most, count(*) as n from d""",
    "brier_bins": """
        with s as (select l.doc_id, l.quality, case when length(d.text) > 4000 then cast(0.95 as double) when length(d.text) > 1500 then cast(0.75 as double) else cast(0.55 as double) end as p from {labels} l join {documents} d on l.doc_id = d.doc_id)
        select least(9, cast(floor(p * 10) as int)) as bin, count(*) as n, sum(quality) as hits, round(avg((p - quality) * (p - quality)), 8) as brier from s group by 1""",
    "b_cubed": """
        with j as (select d.source as c, d.lang as t, count(*) as n from {documents} d group by 1, 2), x as (select n, sum(n) over (partition by c) as nc, sum(n) over (partition by t) as nt from j)
        select round(sum(cast(n as double) * n / nc) / sum(n), 8) as precision_, round(sum(cast(n as double) * n / nt) / sum(n), 8) as recall_ from x""",
    "kish_ess": """
        select c_mktsegment, round(sum(w) * sum(w) / sum(w * w), 6) as ess, count(*) as n from (select c_mktsegment, cast(1 + c_custkey % 7 as double) as w from {customer}) x group by c_mktsegment""",
    "pareto_front": """
        with g as (select n_nationkey as k, sum(case when c_acctbal < 0 then 1 else 0 end) as fp, sum(case when c_acctbal > 9000 then 1 else 0 end) as fn from {nation} join {customer} on n_nationkey = c_nationkey group by 1)
        select a.k, a.fp, a.fn from g a left anti join g b on b.fp <= a.fp and b.fn <= a.fn and (b.fp < a.fp or b.fn < a.fn)""",
    "candidate_prior": """
        with b as (select c_nationkey, c_mktsegment, count(*) as n from {customer} group by 1, 2)
        select sum(n * (n - 1)) as pairs2, count(*) as blocks, max(n) as largest from b""",
    "set_equality": """
        select 'MISSING' as side, n from (select count(*) as n from (select c_custkey from {customer} except select o_custkey from {orders}) x) y
        union all select 'EXTRA' as side, n from (select count(*) as n from (select o_custkey from {orders} except select c_custkey from {customer}) x) y""",
    "monitor_top": """
        select o_orderstatus, o_orderkey, o_totalprice from (select o_orderstatus, o_orderkey, o_totalprice, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as rn from {orders}) x where rn <= 5""",
    "turns_json": """
        select conv_id, count(*) as turns, sum(case when role = 'user' then 1 else 0 end) as user_turns, max(length(text)) as longest, min(turn) as first_turn from {conversations} group by conv_id""",
    "measure_filters": """
        select l_shipmode_class, count(*) as rows_, sum(case when l_returnflag = 'R' then 1 else 0 end) as returned, case when count(*) = 0 then null else cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) / count(*) end as share, count(distinct l_suppkey) as suppliers
        from (select *, case when l_quantity < 10 then 'S' when l_quantity < 30 then 'M' else 'L' end as l_shipmode_class from {lineitem}) x group by l_shipmode_class""",
}

#: What the other engine writes differently: (pattern, replacement).
DIALECT = [
    (r"\{(\w+)\}", r"\1"), (r"datediff\(", "date_diff_days("), (r"percentile\(", "quantile_cont("), (r"as string\)", "as varchar)"), (r"left (semi|anti) join", r"\1 join"),
]


def _closing(text: str, at: int) -> int:
    """Behind the parenthesis that closes the one before `at`."""
    depth = 1
    while depth:
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        at += 1
    return at


def integral_sums(text: str) -> str:
    """Sums of integers as BIGINT, which the other engine would widen; sums of casts and of weights w stay."""
    out, at = "", 0
    for m in re.finditer(r"\bsum\((?!cast\(|w\b)", text):
        if m.start() < at:
            continue
        end = _closing(text, m.end())
        if text[end:].startswith(" over ("):
            end = _closing(text, end + len(" over ("))
        out += f"{text[at : m.start()]}cast({text[m.start() : end]} as bigint)"
        at = end
    return out + text[at:]


def to_oracle(text: str) -> str:
    text = integral_sums(text)
    for pattern, to in DIALECT:
        text = re.sub(pattern, to, text)
    while (at := text.find("date_diff_days(")) >= 0:
        depth, i, cut = 1, at + len("date_diff_days("), None
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            cut = i if text[i] == "," and depth == 1 else cut
            i += 1
        a, b = text[at + len("date_diff_days(") : cut], text[cut + 1 : i - 1]
        text = f"{text[:at]}date_diff('day', {b}, {a}){text[i:]}"
    return text


def queries() -> dict:
    return {k: (lambda spark, sf_dir, text=text: run_sql(spark, sf_dir, text)) for k, text in SQL.items()}


def oracles() -> dict[str, str]:
    return {k: to_oracle(text) for k, text in SQL.items()}
