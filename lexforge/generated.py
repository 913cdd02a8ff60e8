"""Tables that the queries make from the test tables: French articles around words of documents, and reviewed records.

Every value is an expression that Spark and DuckDB read alike, so that a query and its twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Articles around a word {w} of a document: every mining pattern, scope, span pattern and stop marker occurs.
ARTICLES = [
    "Pour l'application du présent code, on entend par « {w} » : un service fourni à distance par voie électronique.",
    "Aux fins du présent titre, on désigne par {w} tout bien meuble.",
    "Au sens du présent article, le mot {w} vaut pour toute personne.",
    "Au sens de la présente section, {w} est un lieu.",
    "Pour l'application de la présente section, le {w} est un lieu clos.",
    "Aux fins de la présente loi, la {w} est libre.",
    "Au sens du présent chapitre, {w} est défini comme un acte écrit et signé par les parties.",
    "Au sens du présent livre, sont définis les {w}.",
    "Un {w} défini comme une action qui dure. Les modalités en sont fixées.",
    "Le {w} est entendu comme un tout. Un décret en fixe la liste.",
    "La chose se définit comme {w}.",
    "Le bien qui dure est qualifié de {w} lorsqu'il est remis au public.",
    "Les biens qui durent sont qualifiés de {w} lorsqu'ils sont remis au public.",
    "Le lieu fermé est considéré comme {w} si son accès est libre. Un arrêté le dit.",
    "Les lieux fermés sont considérés comme {w} lorsque leur accès est libre.",
    "Le {w} est regardé comme un acte.",
    "Le {w} est réputé acquis.",
    "Les {w} sont réputés acquis.",
    "La {w}, qui s'entend de l'exigence générale de bonne foi, est requise.",
    "Le terme « {w} » s'entend de toute somme versée. Ces dispositions sont d'ordre public.",
    "Le {w}, au sens de l'article L. 1, est nul.",
    "Par « {w} », on entend ce qui suit.",
    "La société, ci-après dénommée « {w} », agit.",
    "Le {w} au sens strict est exclu.",
    "1° {w} : toute substance dont le détenteur se défait ;\nÉtat : le pouvoir de décider ;",
    "Déchet : toute substance {w} dont on se défait ;\nDéchet : toute substance {w} dont on se défait ;",
    "Le président désigne les membres, dont {w}.",
    "Cela constitue un {w}.",
    "La présente loi vise le {w}.",
    "Matière ({w}) : un produit livré. Les modalités suivent. Un décret suit.",
    "Objet : le bien {w} qui est vendu au public. Pour l'application du présent alinéa, il est remis.",
    "Le public est informé de {w}.",
    "Pour l'application du présent chapitre, {w} s'entend comme un ensemble de biens.",
    "Dans ce texte on entend par « {w} », un ensemble de biens remis au public. Un décret suit.",
    "Les dispositions {w} sont applicables : la liste est fixée par décret ;",
]


def _word(k: int) -> str:
    return f"split_part(coalesce(text, ''), ' ', {k})"


#: Columns of the reviewed records, over documents with their labels.
REVIEWED = {
    "row_idx": "doc_id",
    "file": "case doc_id % 3 when 0 then 'a.jsonl' when 1 then 'b.jsonl' else 'c.jsonl' end",
    "definition_id": "case when doc_id % 10 = 3 then null else concat('G', cast(doc_id as string)) end",
    "candidate_definition_id": "case when doc_id % 13 = 5 then ' ' else concat('C', cast(doc_id - doc_id % 2 as string)) end",
    "source_code": "case when doc_id % 11 = 0 then 'Code rural (nouveau)' when doc_id % 11 = 1 then 'Code rural et de la pêche maritime.' when doc_id % 11 = 2 then 'code rural et de la peche maritime' when doc_id % 17 = 0 then '' else source end",
    "article_number": "case doc_id % 7 when 0 then 'Article liminaire' when 1 then ' art.  liminaire' else concat('L. ', cast(doc_id % 5 as string)) end",
    "article_id": "case doc_id % 3 when 0 then null when 1 then '' else concat('LEGIARTI', cast(length(text) as string)) end",
    "source_file": "case when doc_id % 6 = 0 then null else concat('f', cast(doc_id % 200 as string), '.xml') end",
    "etat": "'VIGUEUR'",
    "date_debut": "'2020-01-01'",
    "date_fin": "case when doc_id % 4 = 0 then '2021-01-01' else '2999-01-01' end",
    "manual_label": "case when quality = 1 and doc_id % 4 = 1 then 'partial' when quality = 1 then 'valid_definition' when toxic = 1 then 'unsure' when quality = 0 then 'invalid' when doc_id % 2 = 0 then ' ' end",
    "term": f"case when doc_id % 5 = 0 then null else {_word(1)} end",
    "gold_term": f"case when doc_id % 5 = 1 then '' else concat('L', chr(39), {_word(2)}) end",
    "term_candidate": _word(3),
    "definition": "case when doc_id % 4 = 2 then null else text end",
    "gold_definition": "case when doc_id % 8 = 3 then null else text end",
    "definition_candidate": "text",
    "raw_body": "case when doc_id % 9 = 8 then null else text end",
    "scope_text": "cast(null as string)",
    "scope_label": "case when doc_id % 3 = 0 then 'article' end",
    "gold_scope_label": "case when doc_id % 2 = 0 then 'code' end",
    "inferred_scope": "case when doc_id % 5 = 4 then 'section' end",
    "definition_type": "case when doc_id % 8 = 0 then 'explicit_qualification' end",
    "defined_subject": "cast(null as string)",
    "item_number": "cast(null as string)",
    "pattern": "case doc_id % 4 when 0 then 'terme_colon_definition' when 1 then concat('s', chr(39), 'entend de') when 2 then 'on entend par' end",
    "quality": "quality",
    "toxic": "toxic",
}


def reviewed(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.join(labels, "doc_id", "left").selectExpr(*(f"{e} as {n}" for n, e in REVIEWED.items()))


REVIEWED_SQL = "(select " + ", ".join(f"{e} as {n}" for n, e in REVIEWED.items()) + " from documents left join labels using (doc_id))"


def articles(documents: DataFrame) -> DataFrame:
    """id, source_code and text: one article a document, around its first word."""
    at = F.expr(f"cast(doc_id % {len(ARTICLES)} as int)")
    text = F.replace(F.get(F.array(*map(F.lit, ARTICLES)), at), F.lit("{w}"), F.expr(_word(1)))
    return documents.select(F.col("doc_id").alias("id"), F.col("source").alias("source_code"), F.col("lang").alias("article_number"), F.lit(None).cast("string").alias("article_id"), text.alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ARTICLES_SQL = f"(select doc_id as id, source as source_code, lang as article_number, replace(([{', '.join(map(_quoted, ARTICLES))}])[doc_id % {len(ARTICLES)} + 1], '{{w}}', {_word(1)}) as text from documents)"
