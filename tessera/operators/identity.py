"""Routes of identities: the deterministic one, checks of shared identifiers, promoted attributes and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.identifiers import digits_of, valid_cpf
from tessera.functions.names import jaro_winkler, normalize_text, similarity_class
from tessera.operators.pair_counts import pairs_of, without_repeats

#: Why a document may be missing.
ADMITTED = ["SEM_CPF", "EM_REGULARIZACAO", "NAO_INFORMADO_ORIGEM"]


def deterministic_route(cpf: Column, missing_reason: Column, admitted: list[str] = ADMITTED) -> Column:
    """struct(status, method, reason, anchor). A valid document anchors, an invalid one is a conflict, a missing one waits for the
    probabilistic route when its reason is admitted and is a conflict otherwise. Blank counts as missing."""
    blank = F.coalesce(F.trim(cpf) == "", F.lit(True))
    row = lambda status, method, reason, anchor=None: F.struct(F.lit(status).alias("status"), F.lit(method).alias("method"), F.lit(reason).cast("string").alias("reason"), (F.lit(None).cast("string") if anchor is None else anchor).alias("anchor"))
    missing = F.when(F.coalesce(missing_reason.isin(admitted), F.lit(False)), row("NAO_RESOLVIDO", "PENDENTE_PROBABILISTICO", "AGUARDA_LINKAGE_SOB_DEMANDA")).otherwise(row("CONFLITO", "PENDENTE_PROBABILISTICO", "CPF_AUSENTE_SEM_MOTIVO_ADMITIDO"))
    there = F.when(F.coalesce(valid_cpf(cpf), F.lit(False)), row("RESOLVIDO", "CPF_DETERMINISTICO", None, digits_of(cpf))).otherwise(row("CONFLITO", "CPF_DETERMINISTICO", "CPF_ESTRUTURALMENTE_INVALIDO"))
    return F.when(blank, missing).otherwise(there)


def shared_document_conflicts(pairs: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """pairs plus `conflict`: both births are there and differ, and both names are there and alike at the LOW level only.
    left and right: (name, birth) columns of the two holders."""
    x, y = normalize_text(F.col(left[0])), normalize_text(F.col(right[0]))
    d = pairs.withColumn("_x", x).withColumn("_y", y).withColumn("_s", jaro_winkler("_x", "_y"))
    low = F.col("_x").isNotNull() & F.col("_y").isNotNull() & (similarity_class(F.col("_x"), F.col("_y"), F.col("_s")) == "LOW")
    return d.withColumn("conflict", F.coalesce((F.col(left[1]) != F.col(right[1])) & low, F.lit(False))).drop("_x", "_y", "_s")


def shared_document_counts(holders: DataFrame, id_col: str, by: str, name: str, birth: str) -> DataFrame:
    """(by, conflict, n): pairs of different holders of one document (by), judged as shared_document_conflicts does, without making a pair of holders.

    Only pairs of distinct names are compared; holders with equal names never conflict. Of holders whose names conflict those with equal births are taken off.
    """
    d = holders.select(F.col(id_col).alias("_id"), by, normalize_text(F.col(name)).alias("_n"), F.col(birth).alias("_b")).where(F.col(by).isNotNull())
    named = d.where("_n is not null and _b is not null")
    met = lambda s: named.select(by, F.col("_n").alias(s)).distinct()
    pairs = met("_x").join(met("_y"), by).where("_x < _y").select("_x", "_y").distinct()
    low = pairs.where(similarity_class(F.col("_x"), F.col("_y"), jaro_winkler("_x", "_y")) == "LOW")

    def counts(g: DataFrame, keys: list[str]) -> DataFrame:
        every = g.groupBy(*keys).agg(F.count("*").alias("c")).select(by, F.lit(False).alias("conflict"), pairs_of("c").alias("n"))
        out = every
        for each, sign in ((keys, 1), ([*keys, "_b"], -1)):
            sizes = g.where("_n is not null and _b is not null").groupBy(*each, "_n").agg(F.count("*").alias("c"))
            side = lambda n, c: sizes.withColumnRenamed("_n", n).withColumnRenamed("c", c)  # noqa: B023, E731
            apart = side("_x", "_c").join(low, "_x").join(side("_y", "_d"), [*each, "_y"]).select(by, (F.col("_c") * F.col("_d") * sign).alias("n"))
            out = out.unionByName(apart.select(by, F.explode(F.array(F.struct(F.lit(True).alias("conflict"), "n"), F.struct(F.lit(False).alias("conflict"), (-F.col("n")).alias("n")))).alias("k")).select(by, "k.*"))
        return out.groupBy(by, "conflict").agg(F.sum("n").alias("n"))

    return without_repeats(d, "_id", counts, [by]).groupBy(by, "conflict").agg(F.sum("n").alias("n")).where("n > 0")


def promoted(observations: DataFrame, key: list[str], proven: Column, order: list[Column]) -> DataFrame:
    """The best proven observation of each (person, attribute, instance); order holds every tie-break."""
    return observations.where(proven).withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def eligible(observations: DataFrame, high_watermark: int, scope: str | None = None, since: str | None = None) -> DataFrame:
    """Observations (observation_id, cpf, manager, received_at) of a run: no document, up to the watermark, in scope."""
    out = observations.where(F.col("cpf").isNull() & (F.col("observation_id") <= high_watermark))
    out = out if scope is None else out.where(F.col("manager") == scope)
    return out if since is None else out.where(F.col("received_at") >= F.lit(since).cast("timestamp"))


def publication(status: Column, target_established: Column, n_candidates: Column, search_complete: Column, protected: Column, referenced: Column, has_origin: Column, former_target: Column) -> Column:
    """What a run publishes. A protected method is never overruled; a row that has a published reference, or is resolved to an
    established person, is associated; a new identity needs a complete search without any candidate, an origin to hang on
    and no former target elsewhere; everything else stays undefined."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    fresh = yes(search_complete) & (F.coalesce(n_candidates, F.lit(-1)) == 0) & yes(has_origin) & former_target.isNull()
    resolved = yes(status == "RESOLVIDO")
    return F.when(yes(protected), "INDEFINIDA").when(yes(referenced) | (resolved & yes(target_established)), "ASSOCIACAO_EXISTENTE").when(~resolved & fresh, "NOVA_IDENTIDADE").otherwise("INDEFINIDA")


#: Fixed value: successors that are followed at most.
MOST_SUCCESSORS = 31


def canonical_ids(persons: DataFrame) -> DataFrame:
    """(id, canonical) of persons (id, successor): the end of the chain of successors, or null where it is longer than MOST_SUCCESSORS or a ring.

    Steps are composed by doubling, five joins for 31 successors, whatever the chains; a successor that is no person ends its chain.
    """
    step = persons.select("id", F.coalesce("successor", "id").alias("to"))
    out = persons.select("id", F.col("id").alias("at"))
    power = MOST_SUCCESSORS
    while power:
        hop = step.select(F.col("id").alias("at"), F.col("to"))
        if power & 1:
            out = out.join(hop, "at", "left").select("id", F.coalesce("to", "at").alias("at"))
        power >>= 1
        if power:
            step = step.select("id", F.col("to").alias("at")).join(hop, "at", "left").select("id", F.coalesce("to", "at").alias("to"))
    ends = persons.select(F.col("id").alias("at"), F.col("successor").isNotNull().alias("goes_on"))
    return out.join(ends, "at", "left").select("id", F.when(~F.coalesce("goes_on", F.lit(False)), F.col("at")).alias("canonical"))


#: An attribute that no manager but its own ever sees.
SEALED = ("ATRIBUTO_PESSOA", "ENDERECO_CASA_ABRIGO_SIGILOSA")


def permitted(asked: DataFrame, restrictions: DataFrame, now: Column) -> DataFrame:
    """asked (owner, consumer, kind, code) plus `permitted`. Without owner, consumer or kind nothing is; a sealed attribute is for its owner alone; else all is that no
    active restriction (owner, consumer, kind, code, status, starts, ends) forbids. A restriction's null consumer or code stands for all.

    Each of the four ways in which a restriction may be general is an equi-join of its own, so no restriction is compared with every row.
    """
    live = restrictions.where((F.col("status") == "ATIVA") & (F.col("starts") <= now) & (F.col("ends").isNull() | (F.col("ends") > now)))
    d = asked.withColumn("_row", F.struct("owner", "consumer", "kind", "code"))
    barred = F.lit(False)
    for i, (by_code, by_consumer) in enumerate(((True, True), (True, False), (False, True), (False, False))):
        keys = ["owner", "kind", *(["code"] if by_code else []), *(["consumer"] if by_consumer else [])]
        same = (F.col("code").isNotNull() if by_code else F.col("code").isNull()) & (F.col("consumer").isNotNull() if by_consumer else F.col("consumer").isNull())
        d = d.join(live.where(same).select(*keys).distinct().withColumn(f"_b{i}", F.lit(True)), keys, "left")
        barred = barred | F.coalesce(f"_b{i}", F.lit(False))
    known = F.col("owner").isNotNull() & F.col("consumer").isNotNull() & F.col("kind").isNotNull()
    sealed = F.coalesce((F.col("kind") == SEALED[0]) & (F.col("code") == SEALED[1]) & (F.col("owner") != F.col("consumer")), F.lit(False))
    return d.select(*asked.columns, (known & ~sealed & ~barred).alias("permitted"))
