"""Measures of the analytic views by name: aggregates for df.agg() or a groupBy.

Blanks follow the semantic model: a count or sum over no rows is null and not 0, a division by zero is null, "different from"
holds for null, a distinct count counts null as a value, and averages and percentiles leave nulls out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "nullif(count(*), 0)"


def rows_where(condition: str) -> str:
    return f"nullif(count_if({condition}), 0)"


def ratio(a: str, b: str = ROWS) -> str:
    return f"try_divide({a}, {b})"


def share(flag: str, of: str | None = None) -> str:
    """The sum of a 0/1 column by rows, or by the sum of another."""
    return ratio(f"sum({flag})", f"sum({of})" if of else ROWS)


def distinct(c: str) -> str:
    return f"nullif(count(distinct {c}) + coalesce(max(int({c} is null)), 0), 0)"


def only(c: str) -> str:
    """The value when there is one alone."""
    return f"case when count(distinct {c}) + max(int({c} is null)) = 1 then max({c}) end"


def _resolution(suffix: str, general: str) -> dict[str, str]:
    return {
        f"Avaliações de resolução{suffix}": "sum(avaliados)", f"Resolvidos{general}": "sum(resolvidos)", f"Conflitos{general}": "sum(conflitos)", f"Não resolvidos{general}": "sum(nao_resolvidos)",
        f"Taxa de resolução{suffix}": share("resolvidos", "avaliados"), f"Proporção de conflito{suffix}": share("conflitos", "avaliados"), f"Proporção de não resolvido{suffix}": share("nao_resolvidos", "avaliados"),
    }


def _flags(columns: dict[str, str], suffix: str = "") -> dict[str, str]:
    return {f"{name} %{suffix}": share(c) for name, c in columns.items()}


UNASSIGNED = "estado_atribuicao_identidade is distinct from 'ATRIBUIDA'"
IN_QC = {"QC Implementado": "qc_implementado", "QC Valido": "qc_valido", "QC Divergente": "qc_divergente", "QC Nao Verificavel": "qc_nao_verificavel", "Com Versionamento": "possui_versionamento", "Retificacao Vigente": "retificacao_vigente"}

#: table -> (measure -> SQL aggregate). Names are fixed values of the semantic model.
MEASURES: dict[str, dict[str, str]] = {
    "ApiIngestao": {"Requisições API": ROWS, "Requisições API - últimos 10 min": rows_where("ocorrido_em >= current_timestamp() - interval 10 minutes"), "Erros API": "sum(erro)", "Latência Média ms": "avg(duracao_ms)", "Pessoas Consultadas": "sum(qtd_pessoas)"},
    "Atrasos": {
        "Registros Monitorados": ROWS, "Registros em Atraso": rows_where("status_atraso = 'EM_ATRASO'"), "% em Atraso": ratio(rows_where("status_atraso = 'EM_ATRASO'")), "% no Prazo": ratio(rows_where("status_atraso = 'NO_PRAZO'")),
        "Atraso Médio (dias)": "avg(dias_atraso) filter (where status_atraso = 'EM_ATRASO')", "Atraso Máximo (dias)": "max(dias_atraso)", "Atraso P95 (dias)": "percentile(dias_atraso, 0.95) filter (where status_atraso = 'EM_ATRASO')",
    },
    "BeneficiosConcedidos": {"Benefícios Concedidos": ROWS, "Benefícios pendentes/conflitantes": rows_where(UNASSIGNED), "Valor pendente/conflitante": f"sum(valor_concedido) filter (where {UNASSIGNED})", "Tipos de Benefício": distinct("beneficio"), "Gestores": distinct("gestor"), "Soma Valores Concedidos": "sum(valor_concedido)"},
    "CargaInicial": {"Pessoas Processadas": "sum(pessoas_processadas)", "Pessoas por Hora": "max(pessoas_por_hora)"},
    "Catalogo": {"Itens Catálogo": distinct("codigo"), "Versões Ativas": rows_where("status = 'ATIVA'")},
    "IdentidadeProgressiva": {
        "Identidades de Origem": ROWS, "Referências Publicadas": rows_where("estado = 'REFERENCIA'"), "Identidades Provisórias": rows_where("estado = 'PROVISORIA'"), "Identidades Indefinidas": rows_where("estado = 'INDEFINIDA'"),
        "Pessoas com Referência Publicada": "nullif(count(distinct canonical_uuid) filter (where apta_contagem_pessoa_canonica) + count_if(apta_contagem_pessoa_canonica and canonical_uuid is null) div greatest(1, count_if(apta_contagem_pessoa_canonica and canonical_uuid is null)), 0)",
    },
    "Ingestao": {"Entregas": ROWS, "Entregas Completas": rows_where("status = 'PROCESSADA'"), "Entregas Incompletas": rows_where("status is distinct from 'PROCESSADA'")},
    "IngestaoItens": {"Itens Recebidos": ROWS, "Retransmissoes Identicas": "sum(retransmitido)", "Novas Versoes": "sum(nova_versao)", "Taxa de Retransmissao": share("retransmitido")},
    "Linkage": {
        "Cobertura UUID": share("possui_uuid"), "Resolução por CPF": share("resolvido_cpf"), "Fallback probabilístico": share("resolvido_fallback"), "Não resolvidos": ratio(rows_where("status = 'NAO_RESOLVIDO'")), "Conflitos": ratio(rows_where("status = 'CONFLITO'")),
        "CPF com problema %": share("cpf_problema"), "CPFs com problema - Linkage": "sum(cpf_problema)", "Sem candidato no bloco": share("sem_candidato_no_bloco"), "Score médio fallback": "avg(score) filter (where metodo_resolucao = 'LINKAGE_PROBABILISTICO')",
    },
    "LinkageRuns": {"Execuções de linkage": ROWS, "Pessoas avaliadas em runs": "sum(avaliados)", "Resolvidos em runs": "sum(resolvidos)", "Conflitos em runs": "sum(conflitos)", "Sem candidato no bloco - Runs": "sum(sem_candidato_no_bloco)", "Duração média run (s)": "avg(duracao_ms) / 1000"},
    "ManutencaoBronze": {"Objetos Examinados Bronze": "sum(objetos_examinados)", "Orfaos Removidos": "sum(orfaos_removidos)", "Temporarios Removidos": "sum(temporarios_removidos)", "Falhas Storage Bronze": "sum(falhas_storage)", "Locks Nao Adquiridos Bronze": "sum(locks_nao_adquiridos)"},
    "PendenciasIdentidade": {
        "Pendências": ROWS, "Conflitos - Pendências de Identidade": rows_where("linkage_status = 'CONFLITO'"), "CPF Ausente": rows_where("motivo in ('SEM_CPF', 'EM_REGULARIZACAO', 'NAO_INFORMADO_ORIGEM')"),
        "Pendências > 365 dias": rows_where("dias_pendente > 365"), "P95 Dias Pendentes": "percentile(dias_pendente, 0.95)",
    },
    "Possibilidades": {"Possibilidades Compatíveis": ROWS},
    "PossibilidadesPessoas": {"Pessoas com Possibilidade": "max(pessoas)"},
    "QC": {"Registros QC": ROWS, "QC Implementado %": ratio(rows_where("qc_implementacao = 'IMPLEMENTADO'")), "Divergentes %": ratio(rows_where("resultado = 'DIVERGENTE'"))},
    "QualidadeBeneficios": {
        "Registros - Qualidade Benefícios": ROWS, "Geografia % - Benefícios": share("geografia_preenchida"), "Concessao na Janela %": share("concessao_na_janela_permitida", "concessao_janela_verificavel"), "QC Implementado % - Benefícios": share("qc_implementado"),
        **_flags({"Entrega Completa": "entrega_completa", "Medida Preenchida": "medida_preenchida", "Vigencia Coerente": "vigencia_coerente", "Vigencia Conforme Regime": "vigencia_conforme_regime", "Concessao Janela Verificavel": "concessao_janela_verificavel"} | {k: v for k, v in IN_QC.items() if k != "QC Implementado"}),
    },
    "QualidadeEnvios": {
        "Entregas Recebidas": ROWS, "Taxa Processada": share("processada"), "Itens Recebidos - Qualidade de Envios": "sum(itens_recebidos)", "Pessoas Recebidas": "sum(pessoas_recebidas)", "Registros Recebidos": "sum(registros_recebidos)",
        "Retransmissoes Identicas - Qualidade de Envios": "sum(retransmitidos)", "Taxa Retransmissao": share("retransmitidos", "itens_recebidos"), "Entregas com Falha": "sum(com_falha)", "Zero Fatos no Periodo": "sum(zero_fatos_no_periodo)",
        "Tentativas Processor": "sum(tentativas_processamento)", "Recuperacoes Lease": "sum(recuperacoes_lease)", "Lotes Poison": "sum(lotes_poison)",
    },
    "QualidadeIdentidadeOrigem": {
        "Pessoas Observadas": ROWS, "Cobertura CPF": share("cpf_preenchido"), "Cobertura UUID - Identidade por Origem": share("possui_uuid"), "Conflitos - Identidade por Origem": "sum(conflito)", "CPFs com problema": "sum(cpf_problema)",
        "Taxa Sem Candidato no Bloco": ratio("sum(sem_candidato_no_bloco)", rows_where("metodo_resolucao in ('LINKAGE_PROBABILISTICO', 'PENDENTE_PROBABILISTICO')")),
        **{name: rows_where(f"cpf_classificacao = '{c}'") for name, c in {"CPF ausente - QC Identidade": "CPF_AUSENTE", "CPF inválido estrutural": "CPF_ESTRUTURALMENTE_INVALIDO", "CPF em conflito determinístico": "CPF_CONFLITO_DETERMINISTICO", "Duplicação código mesma âncora": "DUPLICACAO_CODIGO_MESMA_ANCORA", "Junção CPFs mesma origem": "JUNCAO_CPFS_MESMA_ORIGEM"}.items()},
        "Divergências identidade abertas": "sum(divergencia_identidade_aberta)", "Nascimento 01/01": share("nascimento_0101"), "Geografia Preenchida": share("geografia_preenchida"),
    },
    "QualidadePessoa": {"Observações Pessoa": ROWS, "CPF %": share("cpf_preenchido"), "Geografia %": share("geografia_preenchida")},
    "QualidadeResolucaoCalibrada": {"PPV estimado": only("ppv_estimado"), "Sensibilidade estimada": only("sensibilidade_estimada"), "Taxa estimada de falso vínculo": only("taxa_falso_vinculo_estimada"), "Taxa estimada de vínculo perdido": only("taxa_vinculo_perdido_estimada")},
    "QualidadeResolucaoOperacional": _resolution("", " - Resolução Geral"),
    "QualidadeResolucaoOperacionalEstrato": _resolution(" - Estrato", " - Estrato"),
    "QualidadeResolucaoOperacionalOrigem": _resolution(" - Origem", " - Origem"),
    "QualidadeServicos": {
        "Registros - Qualidade Serviços": ROWS,
        **_flags({"Entrega Completa": "entrega_completa", "Geografia": "geografia_preenchida"} | IN_QC, " - Serviços"), **_flags({"Data Hora Preenchida": "data_hora_preenchida", "Unidade Preenchida": "unidade_servico_preenchida", "Situacao Preenchida": "situacao_preenchida"}),
    },
    "Registros": {"Registros": ROWS, "Registros pendentes/conflitantes": rows_where(UNASSIGNED), "Benefícios": rows_where("natureza = 'BENEFICIO'"), "Serviços Prestados - Registros": rows_where("natureza = 'SERVICO'")},
    "RegistrosPessoas": {"Pessoas com Registros": "max(pessoas)"},
    "RetencaoBronze": {"Referências Bronze expurgadas": "sum(referencias_expurgadas)", "Objetos físicos removidos": "sum(objetos_fisicos_removidos)", "Objetos compartilhados preservados": "sum(objetos_compartilhados_preservados)", "Falhas de retenção Bronze": "sum(falhas_storage)"},
    "ServicosPrestados": {"Serviços Prestados": ROWS, "Serviços pendentes/conflitantes": rows_where(UNASSIGNED), "Tipos de Serviço": distinct("servico"), "Gestores de Serviços Prestados": distinct("gestor")},
    "Territorializacao": {"Pessoas Observacao": "sum(pessoas_observacao)", "Pessoas Resolvidas": "sum(pessoas_observacao) filter (where situacao_geografia = 'RESOLVIDA')", "Cobertura Territorial Resolvida": ratio("sum(pessoas_observacao) filter (where situacao_geografia = 'RESOLVIDA')", "sum(pessoas_observacao)")},
}

#: Measures whose scope depends on the columns that are grouped by: (measure, column of the scope, scope within, scope of the whole).
SCOPED = {"BeneficiosPessoas": ("Pessoas com Benefícios Concedidos", "gestor", "GESTOR", "TOTAL"), "ServicosPessoas": ("Pessoas com Serviços Prestados", "nome_servico", "SERVICO", "TOTAL")}


def measure(table: str, name: str, by: tuple[str, ...] = ()) -> Column:
    """The aggregate of a measure, under its name; by: the columns that the caller groups by."""
    if table in SCOPED and SCOPED[table][0] == name:
        _, column, within, whole = SCOPED[table]
        found = f"sum(pessoas) filter (where escopo = '{within}')" if column in by else f"max(pessoas) filter (where escopo = '{whole}')"
    else:
        found = MEASURES[table][name]
    return F.expr(found).alias(name)


def measured(df: DataFrame, table: str, names: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by and the measures of a table's rows (all of them by default): one row, or one a group."""
    names = names or ([SCOPED[table][0]] if table in SCOPED else list(MEASURES[table]))
    return df.groupBy(*by).agg(*(measure(table, n, by) for n in names))
