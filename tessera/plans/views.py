"""The analytic views on frames made of the test tables, with SQL of their own, and measures on them.

FRAMES maps the platform's tables on the test tables; both engines read its texts, so a view's two answers start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import measures, views
from tessera.plans.tables import run_sql

NOW = "timestamp '2002-03-01 01:30:00'"
_DAY = "cast(l_shipdate as date)"

FRAMES = {
    "gestor": "select n_nationkey as gestor_id, n_name as codigo from {nation}",
    "sistema_origem": "select r_regionkey as sistema_origem_id, r_name as codigo from {region}",
    "base_pessoa_origem": "select r_regionkey as base_pessoa_origem_id, concat('B-', r_name) as codigo from {region}",
    "tipo_registro": "select n_nationkey as tipo_registro_id, concat('T', n_name) as codigo, concat('Tipo ', n_name) as nome from {nation}",
    "tipo_registro_versao": """select n_nationkey as tipo_registro_versao_id, 1 + n_nationkey % 3 as versao, 20 * (1 + n_nationkey % 4) as prazo_recebimento_dias, case when n_nationkey % 7 <> 0 then 1 else 0 end as monitorar_atraso,
      case n_nationkey % 5 when 0 then 'MONETARIO' when 1 then 'QUANTIDADE' when 2 then 'MONETARIO_E_QUANTIDADE' when 3 then 'SEM_MEDIDA' end as tipo_medida, case n_nationkey % 4 when 0 then 'PRAZO_DETERMINADO' when 1 then 'PRAZO_INDETERMINADO' when 2 then 'NAO_APLICAVEL' end as regime_vigencia,
      case n_nationkey % 6 when 0 then 'DATA_EVENTO_CONCESSAO' when 1 then 'DATA_INICIO_CONCESSAO' when 2 then 'DATA_FIM_CONCESSAO' when 3 then 'DATA_HORA_SERVICO' when 4 then 'SOURCE_AS_OF' end as marco_atraso_codigo,
      case when n_nationkey % 3 = 0 then cast('1996-01-01' as date) end as data_inicio_permitida_concessao, case when n_nationkey % 6 = 0 then cast('1999-01-01' as date) end as data_fim_permitida_concessao from {nation}""",
    "subprefeitura": "select n_nationkey as subprefeitura_id, concat('S ', n_name) as nome from {nation}",
    "distrito": "select n_nationkey as distrito_id, concat('D ', n_name) as nome from {nation}",
    "entrega": """select o_orderkey as entrega_id, cast(o_custkey % 25 as int) as gestor_id, cast(o_custkey % 5 as int) as sistema_origem_id, case when o_orderkey % 5 <> 0 then cast(o_orderkey % 25 as int) end as tipo_registro_id, case when o_orderkey % 2 = 0 then 'BENEFICIO' else 'SERVICO' end as natureza,
      case o_orderstatus when 'F' then 'PROCESSADA' when 'O' then 'QUARENTENA' else 'REJEITADA' end as status, cast(o_orderdate as date) as data_referencia, o_orderdate as recebido_em, cast(o_orderdate as timestamp) + interval '1' day as ultima_atualizacao, o_orderkey % 100000 as bytes_recebidos from {orders}""",
    "lote": """select l_orderkey * 8 + l_linenumber as lote_id, l_orderkey as entrega_id, l_linenumber as sequencia, case when l_orderkey % 3 = 0 then 2 else 4 end as lote_total, case when l_linestatus = 'F' then 'PROCESSADO' when l_returnflag = 'A' then 'REJEITADO' when l_returnflag = 'N' then 'QUARENTENA' else 'POISON' end as status,
      cast(l_quantity as int) as tentativa_count, cast(l_suppkey % 3 as int) as recuperacao_count, case when l_returnflag = 'R' then concat('E', cast(l_suppkey % 9 as string)) end as erro_codigo from {lineitem}""",
    "item_processado": """select l_orderkey * 8 + l_linenumber as lote_id, case when l_suppkey % 2 = 0 then 'PESSOA' else 'REGISTRO' end as classe_item, case l_partkey % 6 when 0 then 'RETRANSMITIDO' when 1 then 'VERSIONADO' when 2 then 'REABERTO' when 3 then 'EXCLUIDO' else 'INCLUIDO' end as resultado,
      case when l_partkey % 4 = 0 then l_shipdate end as consolidado_em from {lineitem} where l_linenumber <= 3""",
    "item_processado_resumo": "select l_orderkey as entrega_id, case when l_suppkey % 2 = 0 then 'PESSOA' else 'REGISTRO' end as classe_item, case l_partkey % 6 when 0 then 'RETRANSMITIDO' when 1 then 'VERSIONADO' when 2 then 'REABERTO' when 3 then 'EXCLUIDO' else 'INCLUIDO' end as resultado, cast(l_quantity as int) as quantidade from {lineitem} where l_linenumber > 3",
    "registro_integrado": f"""select l_orderkey * 8 + l_linenumber as registro_observacao_id, l_orderkey as entrega_id, cast(l_suppkey % 25 as int) as gestor_id, cast(l_partkey % 25 as int) as tipo_registro_id, cast(l_partkey % 25 as int) as tipo_registro_versao_id, case when l_partkey % 2 = 0 then 'BENEFICIO' else 'SERVICO' end as natureza,
      case when l_suppkey % 10 = 0 then 'HISTORICO' else 'VIGENTE' end as status_analitico, case when l_partkey % 3 <> 0 then cast(l_suppkey % 30 as int) end as subprefeitura_referencia_id, case when l_partkey % 3 = 1 then cast(l_suppkey % 25 as int) end as distrito_referencia_id, cast(l_linenumber as int) as versao_interna,
      case l_returnflag when 'R' then 'RETIFICACAO' when 'A' then 'ALTERACAO' else 'INCLUSAO' end as operacao, case when l_linestatus = 'F' then 1 else 0 end as entrega_completa, case when l_quantity > 10 then l_extendedprice end as valor_concedido, case when l_quantity > 5 then l_quantity end as quantidade,
      case l_suppkey % 4 when 0 then 'KG' when 1 then '  ' when 2 then 'UN' end as unidade, case when l_discount > 0.01 then {_DAY} end as data_inicio_concessao, case when l_tax > 0.02 then cast(l_shipdate as date) - cast(l_linenumber as int) + 3 end as data_fim_concessao, case when l_tax > 0.01 then {_DAY} end as data_evento_concessao,
      case when l_discount > 0.03 then l_shipdate end as data_hora_servico, case l_suppkey % 3 when 0 then 'U1' when 1 then ' ' end as unidade_servico, case l_partkey % 4 when 0 then 'CONCLUIDO' when 1 then '' end as situacao, l_shipdate as source_as_of,
      case when l_partkey % 7 = 0 then 'PENDENTE' else 'ATRIBUIDA' end as estado_atribuicao_identidade, case when l_partkey % 7 <> 0 then concat('p', cast(l_orderkey % 500 as string)) end as pessoa_uuid from {{lineitem}}""",
    "qc_registro_implementacao": "select n_nationkey as tipo_registro_versao_id, case when n_nationkey % 2 = 0 then 'IMPLEMENTADO' else 'PENDENTE' end as status from {nation} where n_nationkey % 5 <> 4",
    "qc_registro_resultado": "select l_orderkey * 8 + l_linenumber as registro_observacao_id, case l_suppkey % 5 when 0 then 'DIVERGENTE' when 1 then 'NAO_VERIFICAVEL' else 'VALIDO' end as resultado from {lineitem} where l_quantity > 20",
    "modelo_linkage": "select n_nationkey as modelo_id, concat('A', n_name) as algoritmo_versao, n_regionkey as versao from {nation}",
    "parametro_linkage": "select n_nationkey as modelo_id, case r_regionkey when 0 then 'T_LINKAGE' when 1 then 'CONFLICT_MARGIN' when 2 then 'PRIOR_MATCH_PROBABILITY' when 3 then 'PRIOR_BLOCK_MIN' else 'OUTRO' end as nome, cast(n_nationkey + r_regionkey as double) as valor from {nation} cross join {region} where (n_nationkey + r_regionkey) % 4 <> 0",
    "linkage_run": """select c_custkey as linkage_run_id, c_nationkey as modelo_id, case when c_custkey % 2 = 0 then 'FULL' else 'INCREMENTAL' end as tipo_run, case when c_custkey % 3 = 0 then 'FALHOU' else 'PUBLICADO' end as status, c_custkey * 3 as avaliados, c_custkey * 2 as resolvidos, c_custkey as nao_resolvidos, 0 as conflitos, c_custkey % 5 as sem_candidato_no_bloco,
      cast('2001-01-01 00:00:00' as timestamp) as iniciado_em, case when c_custkey % 4 <> 0 then cast('2001-01-02 10:00:00.250' as timestamp) end as finalizado_em, case when c_custkey % 3 <> 0 then cast('2001-01-03 00:00:00' as timestamp) end as publicado_em from {customer}""",
    "pessoa_origem": "select c_custkey as pessoa_origem_id, case when c_custkey % 6 <> 0 then cast(c_custkey % 5 as int) end as base_pessoa_origem_id from {customer}",
    "pessoa_observacao": """select o_orderkey as pessoa_observacao_id, cast(o_custkey % 25 as int) as gestor_id, l.lote_id, case when o_orderkey % 4 <> 0 then concat('c', cast(o_custkey % 300 as string)) end as cpf, case when o_orderkey % 8 = 0 then 'EM_REGULARIZACAO' end as cpf_ausente_motivo,
      case when o_orderkey % 11 <> 0 then o_custkey end as pessoa_origem_id, cast(concat(cast(1950 + o_orderkey % 50 as string), case when o_orderkey % 9 = 0 then '-01-01' else '-07-15' end) as date) as data_nascimento, cast(o_orderdate as date) as source_as_of
      from {orders} join (select l_orderkey, min(l_orderkey * 8 + l_linenumber) as lote_id from {lineitem} group by l_orderkey) l on l_orderkey = o_orderkey""",
    "vinculo_fonte": """select o_orderkey as pessoa_observacao_id, case when o_orderkey % 4 = 0 then 'NAO_RESOLVIDO' when o_orderkey % 7 = 0 then 'CONFLITO' else 'RESOLVIDO' end as status, case when o_orderkey % 4 = 0 then 'PENDENTE_PROBABILISTICO' when o_orderkey % 13 = 0 then 'CORRECAO_GOVERNADA' else 'CPF_DETERMINISTICO' end as metodo_resolucao,
      case when o_orderkey % 4 <> 0 and o_orderkey % 7 <> 0 then concat('p', cast(o_custkey % 300 as string)) end as pessoa_uuid, case when o_orderkey % 7 = 0 and o_orderkey % 2 = 1 then 'CPF_ESTRUTURALMENTE_INVALIDO' when o_orderkey % 5 = 0 then 'OUTRO' end as motivo from {orders} where o_orderkey % 17 <> 0""",
    "linkage_resultado": """select o_orderkey as pessoa_observacao_id, cast((o_custkey + k.r_regionkey * 7) % 100 as bigint) as linkage_run_id, case (o_orderkey + k.r_regionkey) % 3 when 0 then 'RESOLVIDO' when 1 then 'NAO_RESOLVIDO' else 'CONFLITO' end as status, case when (o_orderkey + k.r_regionkey) % 3 = 0 then concat('q', cast(o_custkey % 200 as string)) end as pessoa_uuid, cast(o_orderkey % 100 as double) / 100 as score,
      case when (o_orderkey + k.r_regionkey) % 3 = 1 then 'SEM_CANDIDATO_NO_RULESET_BLOCKING' when (o_orderkey + k.r_regionkey) % 3 = 2 then 'MARGEM_ENTRE_CANDIDATOS_INSUFICIENTE' end as motivo from {orders} cross join {region} k where o_orderkey % 4 = 0 and k.r_regionkey <= 1""",
    "identity_map": """select c_custkey as identity_map_id, case when c_custkey % 10 = 0 then 'NIS' else 'CPF' end as tipo, concat('c', cast(c_custkey % 300 as string)) as identificador, case when c_custkey % 5 = 0 then cast('2000-01-01' as date) end as vigencia_fim, cast('1990-01-01' as date) as vigencia_inicio, case when c_custkey % 8 = 0 then 'EM_CONFLITO' else 'ATIVO' end as estado, case when c_custkey % 16 = 0 then 'DOIS_TITULARES' end as estado_motivo from {customer}""",
    "divergencia": "select o_orderkey * 2 + k.r_regionkey as divergencia_id, o_orderkey as pessoa_observacao_id, case when o_custkey % 3 = 0 then 'OUTRA' else 'DIVERGENCIA_IDENTIDADE' end as tipo, case when o_custkey % 5 = 0 then o_orderdate end as resolvida_em, o_orderdate as aberta_em, concat('M', cast(k.r_regionkey as string)) as motivo from {orders} cross join {region} k where o_orderkey % 6 = 0 and k.r_regionkey <= 1",
    "referencia_territorial": "select o_orderkey * 2 + k.r_regionkey as referencia_id, o_orderkey as pessoa_observacao_id, cast((o_orderkey + k.r_regionkey) % 2 as int) as ordem_fonte, cast(o_custkey % 3 as int) as ordem_evidencia, o_orderdate as recente_em, case when o_orderkey % 5 <> 0 then cast(o_custkey % 25 as int) end as subprefeitura_id, cast(o_custkey % 28 as int) as distrito_id, case when k.r_regionkey = 0 then 'MORADIA' else 'ATENDIMENTO' end as natureza_referencia from {orders} cross join {region} k where o_orderkey % 3 <> 0 and k.r_regionkey <= 1",
}


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: run_sql(spark, sf_dir, text) for name, text in FRAMES.items()}


def _with(*names: str) -> str:
    """The frames as common table expressions of the other engine."""
    plain = lambda text: text.replace("as string)", "as varchar)").replace("{", "").replace("}", "")
    return "with " + ",\n".join(f"{n} as ({plain(FRAMES[n])})" for n in names)


_WHOLE = "whole as (select entrega_id, cast(bool_and(status = 'PROCESSADO') and min(lote_total) = count(*) and max(lote_total) = count(*) and count(distinct sequencia) = count(*) and min(sequencia) = 1 and max(sequencia) = count(*) as int) entrega_completa from lote group by 1)"
_KIND = "case when e.tipo_registro_id is null then 'CADASTRO' else 'FATUAL' end contexto_entrega, coalesce(tr.codigo, 'CADASTRO') codigo_tipo, coalesce(tr.nome, 'Atualização cadastral de Pessoas') nome_tipo"
_DELIVERY = "entrega e join gestor g using (gestor_id) join sistema_origem s using (sistema_origem_id) left join tipo_registro tr using (tipo_registro_id) left join whole using (entrega_id)"
ENTREGAS = _with("gestor", "sistema_origem", "tipo_registro", "lote", "entrega") + f""", {_WHOLE}, n as (select entrega_id, count(*) filter (where status = 'PROCESSADO') v, max(lote_total) m from lote group by 1)
select e.entrega_id, g.codigo gestor, s.codigo sistema_origem, natureza, {_KIND}, e.status, coalesce(v, 0) lotes_validos, coalesce(m, 0) lote_total_declarado, coalesce(entrega_completa, 0) entrega_completa, data_referencia, recebido_em first_seen_at, ultima_atualizacao, date_diff('minute', recebido_em, ultima_atualizacao) duracao_minutos
from {_DELIVERY} left join n using (entrega_id)"""
ENVIOS = _with("gestor", "sistema_origem", "tipo_registro", "lote", "entrega", "item_processado", "item_processado_resumo") + f""", {_WHOLE},
i as (select entrega_id, classe_item c, resultado r, 1 q from item_processado join lote using (lote_id) where consolidado_em is null union all select entrega_id, classe_item, resultado, quantidade from item_processado_resumo),
x as (select entrega_id, sum(q)::bigint itens_recebidos, coalesce(sum(q) filter (where c = 'PESSOA'), 0)::bigint pessoas_recebidas, coalesce(sum(q) filter (where c = 'REGISTRO'), 0)::bigint registros_recebidos, coalesce(sum(q) filter (where r = 'RETRANSMITIDO'), 0)::bigint retransmitidos,
  coalesce(sum(q) filter (where r in ('VERSIONADO', 'REABERTO', 'EXCLUIDO')), 0)::bigint novas_versoes, coalesce(sum(q) filter (where r = 'INCLUIDO'), 0)::bigint incluidos from i group by 1),
y as (select entrega_id, count(*) lotes, count(*) filter (where status = 'PROCESSADO') lotes_processados, count(*) filter (where status = 'REJEITADO') lotes_rejeitados, count(*) filter (where status = 'QUARENTENA') lotes_quarentena, count(*) filter (where status = 'POISON') lotes_poison, sum(tentativa_count)::bigint tentativas_processamento, sum(recuperacao_count)::bigint recuperacoes_lease, max(erro_codigo) erro_codigo from lote group by 1)
select e.entrega_id, g.codigo gestor, s.codigo sistema_origem, natureza, {_KIND}, e.status, data_referencia, recebido_em, bytes_recebidos, coalesce(entrega_completa, 0) entrega_completa, cast(e.status = 'PROCESSADA' as int) processada, cast(e.status in ('REJEITADA', 'QUARENTENA') as int) com_falha,
  {", ".join(f"coalesce({c}, 0) {c}" for c in ("itens_recebidos", "pessoas_recebidas", "registros_recebidos", "retransmitidos", "novas_versoes", "incluidos", "lotes", "lotes_processados", "lotes_rejeitados", "lotes_quarentena", "lotes_poison", "tentativas_processamento", "recuperacoes_lease"))},
  case when itens_recebidos > 0 then cast(round(retransmitidos / itens_recebidos, 6) as decimal(9,6)) end taxa_retransmissao, cast(e.tipo_registro_id is not null and coalesce(registros_recebidos, 0) = 0 as int) zero_fatos_no_periodo, erro_codigo, date_diff('minute', recebido_em, ultima_atualizacao) duracao_minutos
from {_DELIVERY} left join x using (entrega_id) left join y using (entrega_id)"""
RUNS = _with("modelo_linkage", "parametro_linkage", "linkage_run") + f""", p as (from (pivot (select modelo_id, nome, valor from parametro_linkage) on nome in ('T_LINKAGE', 'CONFLICT_MARGIN', 'PRIOR_MATCH_PROBABILITY', 'PRIOR_BLOCK_MIN', 'PRIOR_BLOCK_MAX', 'MIN_M_INDEPENDENT_PAIRS') using max(valor) group by modelo_id))
select r.linkage_run_id, r.modelo_id, algoritmo_versao, tipo_run, status, avaliados, resolvidos, nao_resolvidos, conflitos, sem_candidato_no_bloco, iniciado_em, finalizado_em, epoch_ms(coalesce(finalizado_em, {NOW})) - epoch_ms(iniciado_em) duracao_ms,
  "T_LINKAGE" t_linkage, "CONFLICT_MARGIN" conflict_margin, "PRIOR_MATCH_PROBABILITY" prior_referencia, "PRIOR_BLOCK_MIN" prior_block_min, "PRIOR_BLOCK_MAX" prior_block_max, "MIN_M_INDEPENDENT_PAIRS" min_m_independent_pairs from linkage_run r join modelo_linkage using (modelo_id) left join p using (modelo_id)"""
_PLACE = "coalesce(sp.nome, 'SEM_REFERENCIA_TERRITORIAL') subprefeitura, coalesce(di.nome, 'SEM_REFERENCIA_TERRITORIAL') distrito"
_FACTS = "registro_integrado r join gestor g using (gestor_id) join tipo_registro tr using (tipo_registro_id) left join subprefeitura sp on sp.subprefeitura_id = r.subprefeitura_referencia_id left join distrito di on di.distrito_id = r.distrito_referencia_id"
_FACT_FRAMES = ("gestor", "tipo_registro", "tipo_registro_versao", "subprefeitura", "distrito", "registro_integrado")
_QC = "q as (select registro_observacao_id, count(*) n, min(case resultado when 'DIVERGENTE' then 1 when 'NAO_VERIFICAVEL' then 2 else 3 end) w from qc_registro_resultado group by 1)"
_QC_COLUMNS = "cast(coalesce(qi.status = 'IMPLEMENTADO', false) as int) qc_implementado, cast(coalesce(w = 3, false) as int) qc_valido, cast(coalesce(w = 1, false) as int) qc_divergente, cast(coalesce(w = 2, false) as int) qc_nao_verificavel, coalesce(n, 0) qtd_regras_qc, cast(versao_interna > 1 as int) possui_versionamento, cast(operacao = 'RETIFICACAO' as int) retificacao_vigente"
_UNIT = "coalesce(trim(unidade), '') <> ''"
BENEFICIOS_Q = _with(*_FACT_FRAMES, "qc_registro_implementacao", "qc_registro_resultado") + f""", {_QC},
f as (select *, data_inicio_concessao b, data_fim_concessao e, data_inicio_permitida_concessao p1, data_fim_permitida_concessao p2, valor_concedido is not null money, quantidade is not null and {_UNIT} amount from registro_integrado join tipo_registro_versao using (tipo_registro_versao_id))
select r.registro_observacao_id, g.codigo gestor, tr.codigo beneficio, tr.nome nome_beneficio, tipo_medida, regime_vigencia, {_PLACE}, versao_interna, operacao, entrega_completa, cast(subprefeitura_referencia_id is not null and distrito_referencia_id is not null as int) geografia_preenchida,
  cast(case tipo_medida when 'MONETARIO' then money when 'QUANTIDADE' then amount when 'MONETARIO_E_QUANTIDADE' then money and amount when 'SEM_MEDIDA' then true end as int) medida_preenchida, cast(coalesce(regime_vigencia in ('PRAZO_DETERMINADO', 'PRAZO_INDETERMINADO') and not coalesce(e < b, false) and not (regime_vigencia = 'PRAZO_DETERMINADO' and e is null), false) as int) vigencia_coerente,
  cast(coalesce(regime_vigencia = 'PRAZO_INDETERMINADO' or regime_vigencia = 'PRAZO_DETERMINADO' and e is not null, false) as int) vigencia_conforme_regime, case when coalesce(p1, p2) is null then 1 when b is not null then cast(b >= coalesce(p1, b) and b <= coalesce(p2, b) as int) end concessao_na_janela_permitida, cast(b is not null or coalesce(p1, p2) is null as int) concessao_janela_verificavel, {_QC_COLUMNS}
from {_FACTS.replace("registro_integrado r", "f r")} left join qc_registro_implementacao qi using (tipo_registro_versao_id) left join q on q.registro_observacao_id = r.registro_observacao_id where natureza = 'BENEFICIO' and status_analitico = 'VIGENTE'"""
SERVICOS_Q = _with(*_FACT_FRAMES, "qc_registro_implementacao", "qc_registro_resultado") + f""", {_QC}
select r.registro_observacao_id, g.codigo gestor, tr.codigo servico, tr.nome nome_servico, {_PLACE}, versao_interna, operacao, entrega_completa, cast(subprefeitura_referencia_id is not null and distrito_referencia_id is not null as int) geografia_preenchida, cast(data_hora_servico is not null as int) data_hora_preenchida,
  cast(coalesce(trim(unidade_servico), '') <> '' as int) unidade_servico_preenchida, cast(coalesce(trim(situacao), '') <> '' as int) situacao_preenchida, {_QC_COLUMNS} from {_FACTS} left join qc_registro_implementacao qi using (tipo_registro_versao_id) left join q on q.registro_observacao_id = r.registro_observacao_id where natureza = 'SERVICO' and status_analitico = 'VIGENTE'"""
CONCEDIDOS = _with(*_FACT_FRAMES) + f""" select registro_observacao_id beneficio_observacao_id, versao_interna, operacao, g.codigo gestor, tr.codigo beneficio, tr.nome nome_beneficio, tipo_medida, estado_atribuicao_identidade, data_inicio_concessao, data_fim_concessao, valor_concedido, quantidade, unidade unidade_medida, {_PLACE}, entrega_completa
from {_FACTS} join tipo_registro_versao using (tipo_registro_versao_id) where natureza = 'BENEFICIO' and status_analitico = 'VIGENTE'"""
REGISTROS = _with(*_FACT_FRAMES) + f""" select left(natureza, 1) || ':' || registro_observacao_id registro_id, natureza, tr.codigo, tr.nome, g.codigo gestor, estado_atribuicao_identidade, source_as_of data_referencia, coalesce(data_hora_servico, data_evento_concessao::timestamp, data_inicio_concessao::timestamp, source_as_of) ocorrido_em, situacao, {_PLACE}, entrega_completa from {_FACTS} where status_analitico = 'VIGENTE'"""
_COUNTED = lambda nature: f"c as (select *, count(*) over () from registro_integrado where natureza = '{nature}' and status_analitico = 'VIGENTE' and estado_atribuicao_identidade = 'ATRIBUIDA')"
PESSOAS_B = _with("gestor", "registro_integrado") + f", {_COUNTED('BENEFICIO')} select 'TOTAL' escopo, null::varchar gestor, count(distinct pessoa_uuid) pessoas from c union all select 'GESTOR', codigo, count(distinct pessoa_uuid) from c join gestor using (gestor_id) group by codigo"
PESSOAS_S = _with("tipo_registro", "registro_integrado") + f", {_COUNTED('SERVICO')} select 'TOTAL' escopo, null::varchar nome_servico, count(distinct pessoa_uuid) pessoas from c union all select 'SERVICO', nome, count(distinct pessoa_uuid) from c join tipo_registro using (tipo_registro_id) group by nome"
ATRASOS = _with(*_FACT_FRAMES, "entrega") + f""", x as (select r.registro_observacao_id, g.codigo gestor, r.natureza, tr.codigo codigo_tipo, tr.nome nome_tipo, versao, prazo_recebimento_dias, marco_atraso_codigo, {_PLACE}, r.entrega_completa, cast(recebido_em::timestamp at time zone 'UTC' at time zone 'America/Sao_Paulo' as date) data_recebimento_sla,
  case marco_atraso_codigo when 'DATA_EVENTO_CONCESSAO' then data_evento_concessao when 'DATA_INICIO_CONCESSAO' then data_inicio_concessao when 'DATA_FIM_CONCESSAO' then data_fim_concessao when 'DATA_HORA_SERVICO' then data_hora_servico::date when 'SOURCE_AS_OF' then source_as_of::date end data_marco_atraso
  from {_FACTS} join tipo_registro_versao using (tipo_registro_versao_id) join entrega e on e.entrega_id = r.entrega_id where monitorar_atraso = 1 and status_analitico = 'VIGENTE'), y as (select *, cast(date_diff('day', data_marco_atraso, data_recebimento_sla) as int) dias_para_recebimento from x),
z as (select *, dias_para_recebimento d, dias_para_recebimento - prazo_recebimento_dias late from y)
select * exclude (d, late), case when d >= 0 then greatest(late, 0) end dias_atraso, case when d is null then 'SEM_MARCO' when d < 0 then 'DATA_FUTURA' when late > 0 then 'EM_ATRASO' else 'NO_PRAZO' end status_atraso,
  case when d is null then 'SEM_MARCO' when d < 0 then 'DATA_FUTURA' when late <= 0 then 'NO_PRAZO' when late between 1 and 3 then '1-3_DIAS' when late between 4 and 7 then '4-7_DIAS' when late between 8 and 30 then '8-30_DIAS' else '31+_DIAS' end faixa_atraso from z"""
_LINKS = """links as (select v.pessoa_observacao_id, coalesce(k.status, v.status) status, case when k.run is null then v.metodo_resolucao else 'LINKAGE_PROBABILISTICO' end metodo_resolucao, case when k.run is null then v.pessoa_uuid else k.pessoa_uuid end pessoa_uuid, k.score, case when k.run is null then v.motivo else k.motivo end why, k.modelo_id, k.run from
  (select coalesce(a.pessoa_observacao_id, b.pessoa_observacao_id) pessoa_observacao_id, a.* exclude (pessoa_observacao_id), a.metodo_resolucao not in ('PENDENTE_PROBABILISTICO', 'LINKAGE_PROBABILISTICO') sure from vinculo_fonte a full join (select distinct pessoa_observacao_id from linkage_resultado) b using (pessoa_observacao_id)) v
  left join (select x.*, linkage_run_id run, modelo_id from linkage_resultado x join linkage_run y using (linkage_run_id) where publicado_em is not null qualify row_number() over (partition by pessoa_observacao_id order by publicado_em desc, iniciado_em desc, linkage_run_id desc) = 1) k
  on k.pessoa_observacao_id = v.pessoa_observacao_id and not coalesce(v.sure, false) where v.metodo_resolucao is not null or k.run is not null)"""
_TERRITORY = "place as (select * from referencia_territorial qualify row_number() over (partition by pessoa_observacao_id order by ordem_fonte, ordem_evidencia, recente_em desc, referencia_id desc) = 1)"
_PERSON_FRAMES = ("gestor", "subprefeitura", "distrito", "lote", "entrega", "linkage_run", "pessoa_observacao", "vinculo_fonte", "linkage_resultado", "referencia_territorial")
_OBSERVED = "pessoa_observacao o join gestor g using (gestor_id) join lote lo using (lote_id) join entrega en on en.entrega_id = lo.entrega_id left join links v using (pessoa_observacao_id) left join place pl using (pessoa_observacao_id) left join subprefeitura sp using (subprefeitura_id) left join distrito di using (distrito_id)"
LINKAGE = _with(*_PERSON_FRAMES, "sistema_origem", "base_pessoa_origem", "pessoa_origem", "modelo_linkage", "parametro_linkage", "identity_map", "divergencia") + f""", {_LINKS}, {_TERRITORY},
m as (select * from identity_map where tipo = 'CPF' and vigencia_fim is null qualify row_number() over (partition by identificador order by vigencia_inicio desc, identity_map_id desc) = 1),
dv as (select * from divergencia where tipo = 'DIVERGENCIA_IDENTIDADE' and resolvida_em is null qualify row_number() over (partition by pessoa_observacao_id order by aberta_em desc, divergencia_id desc) = 1),
c as (select cpf, base_pessoa_origem_id, count(distinct pessoa_origem_id) codes from pessoa_observacao join pessoa_origem using (pessoa_origem_id) group by 1, 2), u as (select pessoa_origem_id, count(distinct cpf) cpfs from pessoa_observacao group by 1),
j as (select o.*, g.codigo gestor, so.codigo sistema_origem, ba.codigo base_pessoa_origem, v.status, metodo_resolucao, v.score, v.pessoa_uuid, why, res.motivo motivo_linkage, m.estado, m.estado_motivo, dv.divergencia_id, dv.motivo dmotivo, pl.subprefeitura_id si, pl.distrito_id dd, pl.natureza_referencia, mo.versao modelo_fallback_versao, v.run, lr.tipo_run, lr.status run_status, pa.valor t_linkage, {_PLACE},
  case when o.cpf is null then 1 when why = 'CPF_ESTRUTURALMENTE_INVALIDO' then 2 when m.estado = 'EM_CONFLITO' then 3 when v.status = 'CONFLITO' and metodo_resolucao = 'CPF_DETERMINISTICO' then 4 when cpfs > 1 then 5 when codes > 1 then 6 else 0 end fault
  from {_OBSERVED} join sistema_origem so using (sistema_origem_id) left join pessoa_origem po on po.pessoa_origem_id = o.pessoa_origem_id left join base_pessoa_origem ba on ba.base_pessoa_origem_id = po.base_pessoa_origem_id left join modelo_linkage mo on mo.modelo_id = v.modelo_id left join parametro_linkage pa on pa.modelo_id = v.modelo_id and pa.nome = 'T_LINKAGE' left join linkage_run lr on lr.linkage_run_id = v.run
  left join linkage_resultado res on res.linkage_run_id = v.run and res.pessoa_observacao_id = o.pessoa_observacao_id left join m on m.identificador = o.cpf left join c on c.cpf = o.cpf and c.base_pessoa_origem_id = po.base_pessoa_origem_id left join u on u.pessoa_origem_id = o.pessoa_origem_id left join dv on dv.pessoa_observacao_id = o.pessoa_observacao_id)
select pessoa_observacao_id, gestor, sistema_origem, base_pessoa_origem, source_as_of, status, metodo_resolucao, case metodo_resolucao when 'LINKAGE_PROBABILISTICO' then score end score, (pessoa_uuid is not null)::int possui_uuid, coalesce(metodo_resolucao = 'CPF_DETERMINISTICO' and status = 'RESOLVIDO', false)::int resolvido_cpf, coalesce(metodo_resolucao = 'LINKAGE_PROBABILISTICO' and status = 'RESOLVIDO', false)::int resolvido_fallback,
  coalesce(status = 'NAO_RESOLVIDO', false)::int nao_resolvido, coalesce(status = 'CONFLITO', false)::int conflito, coalesce(starts_with(motivo_linkage, 'SEM_CANDIDATO'), false)::int sem_candidato_no_bloco, motivo_linkage, (cpf is not null)::int cpf_preenchido, cpf_ausente_motivo,
  ['CPF_SEM_PROBLEMA_DETECTADO', 'CPF_AUSENTE', 'CPF_ESTRUTURALMENTE_INVALIDO', 'CPF_CONFLITO_DETERMINISTICO', 'CPF_CONFLITO_DETERMINISTICO', 'JUNCAO_CPFS_MESMA_ORIGEM', 'DUPLICACAO_CODIGO_MESMA_ANCORA'][fault + 1] cpf_classificacao, (fault > 0)::int cpf_problema,
  [null, coalesce(cpf_ausente_motivo, 'SEM_CPF'), why, coalesce(estado_motivo, 'CPF_EM_CONFLITO_IDENTIDADE'), coalesce(why, 'CPF_CONFLITO_DETERMINISTICO'), 'MAIS_DE_UM_CPF_NA_MESMA_ORIGEM', 'MESMO_CPF_EM_MULTIPLOS_CODIGOS_DA_MESMA_BASE'][fault + 1] cpf_motivo_qualidade, estado cpf_estado_identificador, estado_motivo cpf_estado_motivo,
  (divergencia_id is not null)::int divergencia_identidade_aberta, dmotivo divergencia_identidade_motivo, (strftime(data_nascimento, '%d%m') = '0101')::int nascimento_0101, (si is not null and dd is not null)::int geografia_preenchida, modelo_fallback_versao, run linkage_run_id, tipo_run, t_linkage, run_status linkage_run_status, subprefeitura, distrito, natureza_referencia natureza_referencia_territorial from j"""
PENDENCIAS = _with(*_PERSON_FRAMES) + f""", {_LINKS}, {_TERRITORY}, x as (select o.pessoa_observacao_id, g.codigo gestor, en.recebido_em pendente_desde, {_PLACE}, case when cpf is null then coalesce(cpf_ausente_motivo, 'SEM_CPF') else coalesce(why, v.status) end motivo, case when cpf is null or v.status = 'CONFLITO' then 'ALTA' else 'MEDIA' end prioridade,
  case when metodo_resolucao = 'LINKAGE_PROBABILISTICO' then score end score, v.status linkage_status, metodo_resolucao, cast(date_diff('day', cast(en.recebido_em::timestamp at time zone 'UTC' at time zone 'America/Sao_Paulo' as date), date '2002-02-28') as int) dias_pendente from {_OBSERVED} where cpf is null or v.status <> 'RESOLVIDO')
select *, case when dias_pendente <= 30 then '0-30_DIAS' when dias_pendente <= 90 then '31-90_DIAS' when dias_pendente <= 180 then '91-180_DIAS' when dias_pendente <= 365 then '181-365_DIAS' else '365+_DIAS' end faixa_envelhecimento from x"""
MEASURED = f"select count(*) \"Observações\", round(sum(possui_uuid)::double / count(*), 8) \"Cobertura UUID\", round(sum(cpf_problema)::double / count(*), 8) \"CPF com problema %\", sum(sem_candidato_no_bloco)::bigint sem_candidato from ({LINKAGE})"


def linkage_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.linkage(frames(spark, sf_dir))
    out = d.agg(F.count("*").alias("Observações"), *(measures.measure("Linkage", n) for n in ("Cobertura UUID", "CPF com problema %")), F.sum("sem_candidato_no_bloco").alias("sem_candidato"))
    return out.select(*(F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


_VIEWS = {
    "view_entregas": (views.entregas, ENTREGAS), "view_qualidade_envios": (views.qualidade_envios, ENVIOS), "view_linkage_runs": (lambda t: views.linkage_runs(t, F.expr(NOW)), RUNS), "view_qualidade_beneficios": (views.qualidade_beneficios, BENEFICIOS_Q), "view_qualidade_servicos": (views.qualidade_servicos, SERVICOS_Q),
    "view_beneficios_concedidos": (views.beneficios_concedidos, CONCEDIDOS), "view_registros": (views.registros, REGISTROS), "view_beneficios_pessoas": (lambda t: views.pessoas_por_escopo(t, "BENEFICIO", "gestor", "GESTOR"), PESSOAS_B), "view_servicos_pessoas": (lambda t: views.pessoas_por_escopo(t, "SERVICO", "nome_servico", "SERVICO"), PESSOAS_S),
    "view_atrasos": (views.atrasos, ATRASOS), "view_linkage": (views.linkage, LINKAGE), "view_pendencias": (lambda t: views.pendencias(t, F.expr(NOW)), PENDENCIAS),
}


def queries() -> dict:
    return {k: (lambda spark, sf_dir, view=view: view(frames(spark, sf_dir))) for k, (view, _) in _VIEWS.items()} | {"linkage_measures": linkage_measures}


def oracles() -> dict[str, str]:
    return {k: s for k, (_, s) in _VIEWS.items()} | {"linkage_measures": MEASURED}
