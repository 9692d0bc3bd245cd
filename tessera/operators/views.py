"""The analytic views under their own schemas, as functions over frames; measures.measured() runs on their results.

Each takes the frames that it reads by name; dimensions are joined by key and left to the engine to broadcast by their size. Scalar
aggregates of a row's details are made once for all rows, before they are joined. `now` and the institution's time zone are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import ageing_bucket, lateness_band, lateness_status

#: The names of what is missing, and the reasons of a search without candidates.
NO_TERRITORY, REGISTRY, REGISTRY_NAME, ZONE = "SEM_REFERENCIA_TERRITORIAL", "CADASTRO", "Atualização cadastral de Pessoas", "America/Sao_Paulo"
NO_CANDIDATE = ["SEM_CANDIDATO_NO_BLOCO_DATA_NASCIMENTO", "SEM_CANDIDATO_NOS_BLOCOS_NASCIMENTO_COMPONENTE", "SEM_CANDIDATO_NO_RULESET_BLOCKING"]
NEW_VERSION = ["VERSIONADO", "REABERTO", "EXCLUIDO"]
Frames = dict[str, DataFrame]


def flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def minutes(a: str, b: str) -> Column:
    """Boundaries of minutes between two instants."""
    return F.floor(F.unix_timestamp(F.col(b)) / 60) - F.floor(F.unix_timestamp(F.col(a)) / 60)


def local_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def dim(t: Frames, name: str, key: str, at: str | None = None, **columns: str) -> tuple[DataFrame, str]:
    """A dimension's wanted columns under new names, its key under the name that the fact has for it."""
    return t[name].select(F.col(key).alias(at or key), *(F.col(c).alias(n) for n, c in columns.items())), at or key


def with_dims(d: DataFrame, *dims: tuple[DataFrame, str], how: str = "left") -> DataFrame:
    for other, key in dims:
        d = d.join(other, key, how)
    return d


def territory(t: Frames, d: DataFrame, sub: str, district: str) -> DataFrame:
    d = with_dims(d, dim(t, "subprefeitura", "subprefeitura_id", sub, subprefeitura="nome"), dim(t, "distrito", "distrito_id", district, distrito="nome"))
    return d.withColumns({c: F.coalesce(c, F.lit(NO_TERRITORY)) for c in ("subprefeitura", "distrito")})


def completeness(t: Frames) -> DataFrame:
    """(entrega_id, entrega_completa): all lots of the declared number are there, each once and processed."""
    n, seq, total = F.count("*"), F.col("sequencia"), F.col("lote_total")
    whole = (F.min(total) == F.max(total)) & (F.max(total) == n) & (F.min(seq) == 1) & (F.max(seq) == F.max(total)) & (F.count_distinct(seq) == n) & F.every(F.col("status") == "PROCESSADO")
    return t["lote"].groupBy("entrega_id").agg(flag(whole).alias("entrega_completa"))


def _deliveries(t: Frames) -> DataFrame:
    d = with_dims(t["entrega"], dim(t, "gestor", "gestor_id", gestor="codigo"), dim(t, "sistema_origem", "sistema_origem_id", sistema_origem="codigo"), how="inner")
    d = with_dims(d, dim(t, "tipo_registro", "tipo_registro_id", codigo_tipo="codigo", nome_tipo="nome"), (completeness(t), "entrega_id"))
    return d.withColumns({
        "contexto_entrega": F.when(F.col("tipo_registro_id").isNull(), REGISTRY).otherwise("FATUAL"), "codigo_tipo": F.coalesce("codigo_tipo", F.lit(REGISTRY)), "nome_tipo": F.coalesce("nome_tipo", F.lit(REGISTRY_NAME)),
        "entrega_completa": zero("entrega_completa"), "duracao_minutos": minutes("recebido_em", "ultima_atualizacao"),
    })


def entregas(t: Frames) -> DataFrame:
    lots = t["lote"].groupBy("entrega_id").agg(F.count_if(F.col("status") == "PROCESSADO").alias("lotes_validos"), F.max("lote_total").alias("lote_total_declarado"))
    d = _deliveries(t).join(lots, "entrega_id", "left").withColumns({c: zero(c) for c in ("lotes_validos", "lote_total_declarado")})
    return d.select("entrega_id", "gestor", "sistema_origem", "natureza", "contexto_entrega", "codigo_tipo", "nome_tipo", "status", "lotes_validos", "lote_total_declarado", "entrega_completa", "data_referencia", F.col("recebido_em").alias("first_seen_at"), "ultima_atualizacao", "duracao_minutos")


def qualidade_envios(t: Frames) -> DataFrame:
    """Items still in detail and those that a rollup holds, by delivery."""
    detail = t["item_processado"].where("consolidado_em is null").join(t["lote"].select("lote_id", "entrega_id"), "lote_id").select("entrega_id", "classe_item", "resultado", F.lit(1).cast("long").alias("quantidade"))
    items = detail.unionByName(t["item_processado_resumo"].select("entrega_id", "classe_item", "resultado", F.col("quantidade").cast("long")))
    n = lambda c: F.sum(F.when(c, F.col("quantidade")).otherwise(0))
    kind, result = F.col("classe_item"), F.col("resultado")
    counts = {"itens_recebidos": F.lit(True), "pessoas_recebidas": kind == "PESSOA", "registros_recebidos": kind == "REGISTRO", "retransmitidos": result == "RETRANSMITIDO", "novas_versoes": result.isin(NEW_VERSION), "incluidos": result == "INCLUIDO"}
    by_delivery = items.groupBy("entrega_id").agg(*(n(c).alias(name) for name, c in counts.items()))
    states = {"lotes_processados": "PROCESSADO", "lotes_rejeitados": "REJEITADO", "lotes_quarentena": "QUARENTENA", "lotes_poison": "POISON"}
    sums = {"tentativas_processamento": "tentativa_count", "recuperacoes_lease": "recuperacao_count"}
    lots = t["lote"].groupBy("entrega_id").agg(F.count("*").alias("lotes"), *(F.count_if(F.col("status") == s).alias(c) for c, s in states.items()), *(F.sum(s).alias(c) for c, s in sums.items()), F.max("erro_codigo").alias("erro_codigo"))
    d = with_dims(_deliveries(t), (by_delivery, "entrega_id"), (lots, "entrega_id"))
    d = d.withColumns({c: zero(c) for c in (*counts, "lotes", *states, *sums)})
    wide = lambda c: F.col(c).cast("decimal(28,6)")
    rate = F.when(F.col("itens_recebidos") > 0, (wide("retransmitidos") / wide("itens_recebidos")).cast("decimal(9,6)"))
    return d.select(
        "entrega_id", "gestor", "sistema_origem", "natureza", "contexto_entrega", "codigo_tipo", "nome_tipo", "status", "data_referencia", "recebido_em", "bytes_recebidos", "entrega_completa", flag(F.col("status") == "PROCESSADA").alias("processada"),
        flag(F.col("status").isin("REJEITADA", "QUARENTENA")).alias("com_falha"), *counts, rate.alias("taxa_retransmissao"), flag(F.col("tipo_registro_id").isNotNull() & (F.col("registros_recebidos") == 0)).alias("zero_fatos_no_periodo"), "lotes", *states, *sums, "erro_codigo", "duracao_minutos",
    )


def linkage_runs(t: Frames, now: Column) -> DataFrame:
    """Runs with their model's parameters, of which the long table is pivoted once."""
    names = {"t_linkage": "T_LINKAGE", "conflict_margin": "CONFLICT_MARGIN", "prior_referencia": "PRIOR_MATCH_PROBABILITY", "prior_block_min": "PRIOR_BLOCK_MIN", "prior_block_max": "PRIOR_BLOCK_MAX", "min_m_independent_pairs": "MIN_M_INDEPENDENT_PAIRS"}
    values = t["parametro_linkage"].where(F.col("nome").isin(list(names.values()))).groupBy("modelo_id").agg(*(F.max(F.when(F.col("nome") == n, F.col("valor"))).alias(c) for c, n in names.items()))
    took = (F.unix_millis(F.coalesce("finalizado_em", now)) - F.unix_millis("iniciado_em")).alias("duracao_ms")
    d = t["linkage_run"].join(t["modelo_linkage"].select("modelo_id", "algoritmo_versao"), "modelo_id").join(values, "modelo_id", "left")
    return d.select("linkage_run_id", "modelo_id", "algoritmo_versao", "tipo_run", "status", "avaliados", "resolvidos", "nao_resolvidos", "conflitos", "sem_candidato_no_bloco", "iniciado_em", "finalizado_em", took, *names)


def _facts(t: Frames, nature: str | None = None) -> DataFrame:
    """Current facts with their manager, kind, contract version and territory."""
    d = t["registro_integrado"].where("status_analitico = 'VIGENTE'")
    d = d if nature is None else d.where(F.col("natureza") == nature)
    d = with_dims(d, dim(t, "gestor", "gestor_id", gestor="codigo"), dim(t, "tipo_registro", "tipo_registro_id", codigo_tipo="codigo", nome_tipo="nome"), how="inner")
    return territory(t, d, "subprefeitura_referencia_id", "distrito_referencia_id")


def _with_qc(t: Frames, d: DataFrame) -> DataFrame:
    """The worst result of a fact's rules: divergent, then not verifiable, then valid; null without rules."""
    r = F.col("resultado")
    worst = F.when(F.count_if(r == "DIVERGENTE") > 0, "DIVERGENTE").when(F.count_if(r == "NAO_VERIFICAVEL") > 0, "NAO_VERIFICAVEL").otherwise("VALIDO")
    judged = t["qc_registro_resultado"].groupBy("registro_observacao_id").agg(F.count("*").alias("qtd_regras_qc"), worst.alias("_qc"))
    return with_dims(d, dim(t, "qc_registro_implementacao", "tipo_registro_versao_id", _qci="status"), (judged, "registro_observacao_id"))


def _quality_flags() -> list[Column]:
    results = {"qc_valido": "VALIDO", "qc_divergente": "DIVERGENTE", "qc_nao_verificavel": "NAO_VERIFICAVEL"}
    return [
        flag(F.col("_qci") == "IMPLEMENTADO").alias("qc_implementado"), *(flag(F.col("_qc") == v).alias(c) for c, v in results.items()), zero("qtd_regras_qc").alias("qtd_regras_qc"),
        flag(F.col("versao_interna") > 1).alias("possui_versionamento"), flag(F.col("operacao") == "RETIFICACAO").alias("retificacao_vigente"),
    ]


def _placed() -> Column:
    return flag(F.col("subprefeitura_referencia_id").isNotNull() & F.col("distrito_referencia_id").isNotNull()).alias("geografia_preenchida")


def qualidade_beneficios(t: Frames) -> DataFrame:
    contract = t["tipo_registro_versao"].select("tipo_registro_versao_id", "tipo_medida", "regime_vigencia", "data_inicio_permitida_concessao", "data_fim_permitida_concessao")
    d = _with_qc(t, _facts(t, "BENEFICIO").join(contract, "tipo_registro_versao_id"))
    begin, end, first, last = (F.col(c) for c in ("data_inicio_concessao", "data_fim_concessao", "data_inicio_permitida_concessao", "data_fim_permitida_concessao"))
    money, amount = F.col("valor_concedido").isNotNull(), F.col("quantidade").isNotNull() & filled("unidade")
    regime = F.col("regime_vigencia")
    measured = F.when(F.col("tipo_medida") == "MONETARIO", flag(money)).when(F.col("tipo_medida") == "QUANTIDADE", flag(amount)).when(F.col("tipo_medida") == "MONETARIO_E_QUANTIDADE", flag(money & amount)).when(F.col("tipo_medida") == "SEM_MEDIDA", 1)
    coherent = F.when(F.coalesce(end < begin, F.lit(False)) | ((regime == "PRAZO_DETERMINADO") & end.isNull()), 0).otherwise(flag(regime.isNotNull() & (regime != "NAO_APLICAVEL")))
    window = (first.isNotNull() | last.isNotNull()) & begin.isNull()
    inside = flag((first.isNull() | (begin >= first)) & (last.isNull() | (begin <= last)))
    return d.select(
        "registro_observacao_id", "gestor", F.col("codigo_tipo").alias("beneficio"), F.col("nome_tipo").alias("nome_beneficio"), "tipo_medida", "regime_vigencia", "subprefeitura", "distrito", "versao_interna", "operacao",
        flag(F.col("entrega_completa") == 1).alias("entrega_completa"), _placed(), measured.alias("medida_preenchida"), coherent.alias("vigencia_coerente"),
        flag((regime == "PRAZO_INDETERMINADO") | ((regime == "PRAZO_DETERMINADO") & end.isNotNull())).alias("vigencia_conforme_regime"), F.when(~window, inside).alias("concessao_na_janela_permitida"), flag(~window).alias("concessao_janela_verificavel"), *_quality_flags(),
    )


def qualidade_servicos(t: Frames) -> DataFrame:
    d = _with_qc(t, _facts(t, "SERVICO").join(t["tipo_registro_versao"].select("tipo_registro_versao_id"), "tipo_registro_versao_id"))
    return d.select(
        "registro_observacao_id", "gestor", F.col("codigo_tipo").alias("servico"), F.col("nome_tipo").alias("nome_servico"), "subprefeitura", "distrito", "versao_interna", "operacao", flag(F.col("entrega_completa") == 1).alias("entrega_completa"), _placed(),
        flag(F.col("data_hora_servico").isNotNull()).alias("data_hora_preenchida"), flag(filled("unidade_servico")).alias("unidade_servico_preenchida"), flag(filled("situacao")).alias("situacao_preenchida"), *_quality_flags(),
    )


def beneficios_concedidos(t: Frames) -> DataFrame:
    d = _facts(t, "BENEFICIO").join(t["tipo_registro_versao"].select("tipo_registro_versao_id", "tipo_medida"), "tipo_registro_versao_id")
    return d.select(F.col("registro_observacao_id").alias("beneficio_observacao_id"), "versao_interna", "operacao", "gestor", F.col("codigo_tipo").alias("beneficio"), F.col("nome_tipo").alias("nome_beneficio"), "tipo_medida", "estado_atribuicao_identidade", "data_inicio_concessao", "data_fim_concessao", "valor_concedido", "quantidade", F.col("unidade").alias("unidade_medida"), "subprefeitura", "distrito", "entrega_completa")


def registros(t: Frames) -> DataFrame:
    letter = F.when(F.col("natureza") == "BENEFICIO", "B:").otherwise("S:")
    at = F.coalesce("data_hora_servico", F.col("data_evento_concessao").cast("timestamp"), F.col("data_inicio_concessao").cast("timestamp"), "source_as_of")
    return _facts(t).select(F.concat(letter, F.col("registro_observacao_id").cast("string")).alias("registro_id"), "natureza", F.col("codigo_tipo").alias("codigo"), F.col("nome_tipo").alias("nome"), "gestor", "estado_atribuicao_identidade", F.col("source_as_of").alias("data_referencia"), at.alias("ocorrido_em"), "situacao", "subprefeitura", "distrito", "entrega_completa")


def pessoas_por_escopo(t: Frames, nature: str, by: str, scope: str) -> DataFrame:
    """Distinct persons of attributed facts, in total and by a column; one expansion of the rows and one distinct count for both."""
    d = t["registro_integrado"].where((F.col("status_analitico") == "VIGENTE") & (F.col("natureza") == nature) & (F.col("estado_atribuicao_identidade") == "ATRIBUIDA"))
    d = with_dims(d, dim(t, "gestor", "gestor_id", gestor="codigo") if by == "gestor" else dim(t, "tipo_registro", "tipo_registro_id", **{by: "nome"}))
    g = d.groupingSets([[], [by]], by).agg(F.grouping(by).alias("_all"), F.count_distinct("pessoa_uuid").alias("pessoas"))
    return g.where(F.col(by).isNotNull() | (F.col("_all") == 1)).select(F.when(F.col("_all") == 1, "TOTAL").otherwise(scope).alias("escopo"), by, "pessoas")


def atrasos(t: Frames) -> DataFrame:
    contract = t["tipo_registro_versao"].where("monitorar_atraso = 1").select("tipo_registro_versao_id", "versao", "prazo_recebimento_dias", "marco_atraso_codigo")
    d = _facts(t).join(contract, "tipo_registro_versao_id").join(t["entrega"].select("entrega_id", "recebido_em"), "entrega_id")
    code = F.col("marco_atraso_codigo")
    dates = {"DATA_EVENTO_CONCESSAO": "data_evento_concessao", "DATA_INICIO_CONCESSAO": "data_inicio_concessao", "DATA_FIM_CONCESSAO": "data_fim_concessao", "DATA_HORA_SERVICO": "data_hora_servico", "SOURCE_AS_OF": "source_as_of"}
    d = d.withColumn("data_marco_atraso", F.coalesce(*(F.when(code == k, F.to_date(c)) for k, c in dates.items()))).withColumn("data_recebimento_sla", local_date(F.col("recebido_em")))
    d = d.withColumn("dias_para_recebimento", F.datediff("data_recebimento_sla", "data_marco_atraso"))
    days, allowed = F.col("dias_para_recebimento"), F.col("prazo_recebimento_dias")
    return d.select(
        "registro_observacao_id", "gestor", "natureza", "codigo_tipo", "nome_tipo", "versao", "prazo_recebimento_dias", "marco_atraso_codigo", "data_marco_atraso", "data_recebimento_sla", "dias_para_recebimento",
        F.when(days >= 0, F.greatest(days - allowed, F.lit(0))).alias("dias_atraso"), lateness_status(days, allowed).alias("status_atraso"), lateness_band(days, allowed).alias("faixa_atraso"), "subprefeitura", "distrito", "entrega_completa",
    )


def current_links(t: Frames) -> DataFrame:
    """The link of each observation: a deterministic or governed one if there is one, else the latest published result."""
    sure = t["vinculo_fonte"].where("metodo_resolucao not in ('LINKAGE_PROBABILISTICO', 'PENDENTE_PROBABILISTICO')")
    latest = Window.partitionBy("pessoa_observacao_id").orderBy(F.desc("publicado_em"), F.desc("iniciado_em"), F.desc("linkage_run_id"))
    found = t["linkage_resultado"].join(t["linkage_run"].where("publicado_em is not null").select("linkage_run_id", "modelo_id", "publicado_em", "iniciado_em"), "linkage_run_id").withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    found = found.join(sure.select("pessoa_observacao_id"), "pessoa_observacao_id", "left_anti")
    columns = ["pessoa_observacao_id", "status", "metodo_resolucao", "pessoa_uuid", "score", "motivo", "modelo_id", "linkage_run_id"]
    pending = t["vinculo_fonte"].where("metodo_resolucao = 'PENDENTE_PROBABILISTICO'").join(found.select("pessoa_observacao_id"), "pessoa_observacao_id", "left_anti")
    none = lambda d: d.select("pessoa_observacao_id", "status", "metodo_resolucao", "pessoa_uuid", F.lit(None).cast("double").alias("score"), "motivo", F.lit(None).cast("long").alias("modelo_id"), F.lit(None).cast("long").alias("linkage_run_id"))
    return none(sure).unionByName(none(pending)).unionByName(found.withColumn("metodo_resolucao", F.lit("LINKAGE_PROBABILISTICO")).select(columns))


def best_territory(t: Frames) -> DataFrame:
    """One reference for each observation: by kind of source, evidence, recency and id."""
    order = Window.partitionBy("pessoa_observacao_id").orderBy("ordem_fonte", "ordem_evidencia", F.desc("recente_em"), F.desc("referencia_id"))
    return t["referencia_territorial"].withColumn("_n", F.row_number().over(order)).where("_n = 1").select("pessoa_observacao_id", "subprefeitura_id", "distrito_id", "natureza_referencia")


def linkage(t: Frames) -> DataFrame:
    """Observations with their link, its run and model, the state of their document and their territory.

    Counts over documents and over sources are made once each, and the latest open rows by a window, so no row looks anything up by itself.
    """
    o = t["pessoa_observacao"]
    origin = t["pessoa_origem"].select("pessoa_origem_id", "base_pessoa_origem_id")
    with_base = o.select("pessoa_observacao_id", "pessoa_origem_id", "cpf").join(origin, "pessoa_origem_id")
    codes = with_base.where("cpf is not null and base_pessoa_origem_id is not null").groupBy("cpf", "base_pessoa_origem_id").agg(F.count_distinct("pessoa_origem_id").alias("codigos"))
    documents = o.where("pessoa_origem_id is not null").groupBy("pessoa_origem_id").agg(F.count_distinct("cpf").alias("cpfs"))
    open_map = t["identity_map"].where("tipo = 'CPF' and vigencia_fim is null").withColumn("_n", F.row_number().over(Window.partitionBy("identificador").orderBy(F.desc("vigencia_inicio"), F.desc("identity_map_id")))).where("_n = 1")
    open_map = open_map.select(F.col("identificador").alias("cpf"), F.col("estado").alias("cpf_estado_identificador"), F.col("estado_motivo").alias("cpf_estado_motivo"))
    disputes = t["divergencia"].where("tipo = 'DIVERGENCIA_IDENTIDADE' and resolvida_em is null").withColumn("_n", F.row_number().over(Window.partitionBy("pessoa_observacao_id").orderBy(F.desc("aberta_em"), F.desc("divergencia_id")))).where("_n = 1")
    disputes = disputes.select("pessoa_observacao_id", "divergencia_id", F.col("motivo").alias("divergencia_identidade_motivo"))
    vc = current_links(t).withColumnRenamed("motivo", "_why")
    runs = t["linkage_run"].select("linkage_run_id", "tipo_run", F.col("status").alias("linkage_run_status"))
    results = t["linkage_resultado"].select("linkage_run_id", "pessoa_observacao_id", F.col("motivo").alias("motivo_linkage"))
    threshold = t["parametro_linkage"].where("nome = 'T_LINKAGE'").select("modelo_id", F.col("valor").alias("t_linkage"))
    d = with_dims(o, dim(t, "gestor", "gestor_id", gestor="codigo"), how="inner").join(t["lote"].select("lote_id", "entrega_id"), "lote_id").join(t["entrega"].select("entrega_id", "sistema_origem_id"), "entrega_id")
    d = with_dims(d, dim(t, "sistema_origem", "sistema_origem_id", sistema_origem="codigo"), how="inner")
    d = with_dims(d, (origin, "pessoa_origem_id"), dim(t, "base_pessoa_origem", "base_pessoa_origem_id", base_pessoa_origem="codigo"), (vc, "pessoa_observacao_id"), dim(t, "modelo_linkage", "modelo_id", modelo_fallback_versao="versao"), (threshold, "modelo_id"), (runs, "linkage_run_id"))
    d = d.join(results, ["linkage_run_id", "pessoa_observacao_id"], "left").join(codes, ["cpf", "base_pessoa_origem_id"], "left")
    d = with_dims(d, (documents, "pessoa_origem_id"), (open_map, "cpf"), (disputes, "pessoa_observacao_id"), (best_territory(t), "pessoa_observacao_id"))
    d = territory(t, d, "subprefeitura_id", "distrito_id")
    status, method, yes = F.col("status"), F.col("metodo_resolucao"), (lambda c: F.coalesce(c, F.lit(False)))
    # (holds, class, reason), the first that holds.
    faults = [
        (F.col("cpf").isNull(), "CPF_AUSENTE", F.coalesce("cpf_ausente_motivo", F.lit("SEM_CPF"))), (yes(F.col("_why") == "CPF_ESTRUTURALMENTE_INVALIDO"), "CPF_ESTRUTURALMENTE_INVALIDO", F.col("_why")),
        (yes(F.col("cpf_estado_identificador") == "EM_CONFLITO"), "CPF_CONFLITO_DETERMINISTICO", F.coalesce("cpf_estado_motivo", F.lit("CPF_EM_CONFLITO_IDENTIDADE"))),
        (yes((status == "CONFLITO") & (method == "CPF_DETERMINISTICO")), "CPF_CONFLITO_DETERMINISTICO", F.coalesce("_why", F.lit("CPF_CONFLITO_DETERMINISTICO"))),
        (yes(F.col("cpfs") > 1), "JUNCAO_CPFS_MESMA_ORIGEM", F.lit("MAIS_DE_UM_CPF_NA_MESMA_ORIGEM")), (yes(F.col("codigos") > 1), "DUPLICACAO_CODIGO_MESMA_ANCORA", F.lit("MESMO_CPF_EM_MULTIPLOS_CODIGOS_DA_MESMA_BASE")),
    ]
    held = F.coalesce(*(F.when(h, F.struct(F.lit(c).alias("c"), r.alias("r"))) for h, c, r in faults))
    d = d.withColumn("_fault", held)
    by = lambda m: flag((method == m) & (status == "RESOLVIDO"))
    return d.select(
        "pessoa_observacao_id", "gestor", "sistema_origem", "base_pessoa_origem", "source_as_of", "status", "metodo_resolucao", F.when(method == "LINKAGE_PROBABILISTICO", F.col("score")).alias("score"), flag(F.col("pessoa_uuid").isNotNull()).alias("possui_uuid"),
        by("CPF_DETERMINISTICO").alias("resolvido_cpf"), by("LINKAGE_PROBABILISTICO").alias("resolvido_fallback"), flag(status == "NAO_RESOLVIDO").alias("nao_resolvido"), flag(status == "CONFLITO").alias("conflito"), flag(F.col("motivo_linkage").isin(NO_CANDIDATE)).alias("sem_candidato_no_bloco"), "motivo_linkage",
        flag(F.col("cpf").isNotNull()).alias("cpf_preenchido"), "cpf_ausente_motivo", F.coalesce("_fault.c", F.lit("CPF_SEM_PROBLEMA_DETECTADO")).alias("cpf_classificacao"), flag(F.col("_fault").isNotNull()).alias("cpf_problema"), F.col("_fault.r").alias("cpf_motivo_qualidade"),
        "cpf_estado_identificador", "cpf_estado_motivo", flag(F.col("divergencia_id").isNotNull()).alias("divergencia_identidade_aberta"), "divergencia_identidade_motivo", flag((F.dayofmonth("data_nascimento") == 1) & (F.month("data_nascimento") == 1)).alias("nascimento_0101"),
        flag(F.col("subprefeitura_id").isNotNull() & F.col("distrito_id").isNotNull()).alias("geografia_preenchida"), "modelo_fallback_versao", "linkage_run_id", "tipo_run", "t_linkage", "linkage_run_status", "subprefeitura", "distrito", F.col("natureza_referencia").alias("natureza_referencia_territorial"),
    )


def pendencias(t: Frames, now: Column) -> DataFrame:
    """Observations without a document or without a link, by how long they wait."""
    d = with_dims(t["pessoa_observacao"], dim(t, "gestor", "gestor_id", gestor="codigo"), how="inner").join(t["lote"].select("lote_id", "entrega_id"), "lote_id").join(t["entrega"].select("entrega_id", F.col("recebido_em").alias("pendente_desde")), "entrega_id")
    d = with_dims(d, (current_links(t), "pessoa_observacao_id"), (best_territory(t), "pessoa_observacao_id")).where(F.col("cpf").isNull() | F.col("status").isin("NAO_RESOLVIDO", "CONFLITO"))
    d = territory(t, d, "subprefeitura_id", "distrito_id").withColumn("dias_pendente", F.datediff(local_date(now), local_date(F.col("pendente_desde"))))
    missing = F.col("cpf").isNull()
    return d.select(
        "pessoa_observacao_id", "gestor", "pendente_desde", "subprefeitura", "distrito", F.when(missing, F.coalesce("cpf_ausente_motivo", F.lit("SEM_CPF"))).otherwise(F.coalesce("motivo", "status")).alias("motivo"),
        F.when((F.col("status") == "CONFLITO") | missing, "ALTA").otherwise("MEDIA").alias("prioridade"), F.when(F.col("metodo_resolucao") == "LINKAGE_PROBABILISTICO", F.col("score")).alias("score"), F.col("status").alias("linkage_status"), "metodo_resolucao", "dias_pendente", ageing_bucket(F.col("dias_pendente")).alias("faixa_envelhecimento"),
    )
