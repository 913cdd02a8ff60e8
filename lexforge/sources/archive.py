"""TAR archives of XML articles.

Python only opens archives and walks XML trees (malformed XML gives no rows); every choice among the texts found is a
Spark expression. One archive is one record of Spark's binaryFile source, which bounds it at 2 GB; loose XML files and
any number of archives are read alike. No archive's content leaves its task.
"""

from __future__ import annotations

import io
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# The tags and attributes that hold each field, in order of preference, and the markers of the prefilter.
FIELDS = {
    "article_number": (("NUM", "NUM_ARTICLE", "ARTICLE_NUM", "NUMERO"), ("num", "numero", "NUM", "NUMERO")),
    "article_id": (("ID", "CID", "ID_ARTICLE"), ("id", "cid", "ID", "CID")),
    "etat": (("ETAT", "ETAT_JURIDIQUE"), ()),
    "date_debut": (("DEBUT", "DATE_DEBUT", "DATEDEBUT"), ("DEBUT", "DATE_DEBUT", "DATEDEBUT")),
    "date_fin": (("FIN", "DATE_FIN", "DATEFIN"), ("FIN", "DATE_FIN", "DATEFIN")),
}
TITLE_TAGS = ("TITRE_TXT", "TITRE", "TITREFULL", "NOM_CODE", "LIBELLE", "TITLE")
BLOCK_TAGS = ("BLOC_TEXTUEL", "CONTENU")
MARKERS = ("on entend par", "au sens du présent", "au sens de la présente", "pour l'application du présent", "pour l’application du présent", "défini comme", "définie comme", "définis comme", "définies comme", "sont qualifiés de", "est qualifié de", "sont considérés comme", "est considéré comme")
#: A code's title, and what a path of its articles may contain.
CODES = [
    ("Code de la consommation", ("code de la consommation", "code_de_la_consommation", "code-de-la-consommation")),
    ("Code de l'environnement", ("code de l'environnement", "code_de_l_environnement", "code-de-l-environnement")),
    ("Code du travail", ("code du travail", "code_du_travail", "code-du-travail")),
    ("Code de la santé publique", ("code de la santé publique", "code_de_la_sante_publique", "code-de-la-sante-publique")),
    ("Code des postes et des communications électroniques", ("code des postes", "code_des_postes", "code-des-postes")),
]
MEMBER = "archive string, member string, is_file boolean, size bigint, relevant boolean, xml binary"
FOUND = "source_file string, titles array<string>, blocks array<string>, whole string, " + ", ".join(f"{f} array<string>" for f in FIELDS)


def relevant(name: Column) -> Column:
    """Paths of articles of codes in force."""
    p = F.lower(F.translate(name, "\\", "/"))
    has = lambda s: F.contains(p, F.lit(s))
    return F.endswith(p, F.lit(".xml")) & (has("/article/") | has("legiarti")) & has("code_et_tnc_en_vigueur") & ~has("code_et_tnc_non_vigueur") & ~has("/tnc_en_vigueur/") & ~has("/tnc_non_vigueur/")


def has_marker(xml: Column, prefix: int = 200_000) -> Column:
    """The optional prefilter on the first bytes of a file."""
    head = F.lower(F.decode(F.substring(xml, 1, prefix), "UTF-8"))
    return X.any_of([F.contains(head, F.lit(m)) for m in MARKERS])


def source_of_path(name: Column) -> Column:
    p = F.lower(name)
    named = [F.when(X.any_of([F.contains(p, F.lit(part)) for part in parts]), title) for title, parts in CODES]
    return F.coalesce(*named, F.lit("unknown"))


def members(spark: SparkSession, path: str) -> DataFrame:
    """A row per member of the archives under ``path``; the content of files only. Counters are aggregates of it."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_buffer()), mode="r:*") as tar:
                    for m in tar:
                        data = tar.extractfile(m).read() if m.isfile() and m.name.lower().endswith(".xml") else None
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "member": [m.name], "is_file": [m.isfile()], "size": [m.size], "xml": pa.array([data], pa.binary())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "content").mapInArrow(opened, "archive string, member string, is_file boolean, size bigint, xml binary")
    return rows.withColumn("relevant", F.col("is_file") & relevant(F.col("member")))


def loose_files(spark: SparkSession, path: str) -> DataFrame:
    """XML files in folders, as members of no archive; irrelevant paths are dropped before their content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path)
    return files.where(relevant(F.col("path"))).select(F.lit(None).cast("string").alias("archive"), F.col("path").alias("member"), F.lit(True).alias("is_file"), F.col("length").alias("size"), F.col("content").alias("xml"), F.lit(True).alias("relevant"))


def _tag(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _text(node: ET.Element) -> str:
    return " ".join(filter(None, (t.strip() for t in node.itertext())))


def _candidates(article: ET.Element, tags: tuple[str, ...], attributes: tuple[str, ...]) -> list[str]:
    nodes = list(article.iter())
    return [_text(n) for n in nodes if _tag(n) in tags] + [n.attrib[a] for n in nodes for a in attributes if a in n.attrib]


def articles(found: DataFrame) -> DataFrame:
    """article_id, source_code, article_number, etat, date_debut, date_fin, text, source_file of every article in rows
    (member, xml); those without text, or with neither number nor id, are dropped."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.split()[0] for c in FOUND.split(", ")]
        kind = pa.schema([(c, pa.string() if c in ("source_file", "whole") else pa.list_(pa.string())) for c in columns])
        for b in batches:
            rows = []
            for name, xml in zip(b["member"].to_pylist(), b["xml"].to_pylist(), strict=True):
                try:
                    root = ET.fromstring(xml or b"")
                except ET.ParseError:
                    continue
                titles = [_text(n) for n in root.iter() if _tag(n) in TITLE_TAGS]
                for a in (n for n in root.iter() if _tag(n) == "ARTICLE"):
                    rows.append({"source_file": name, "titles": titles, "blocks": _candidates(a, BLOCK_TAGS, ()), "whole": _text(a)} | {f: _candidates(a, *where) for f, where in FIELDS.items()})
            yield pa.RecordBatch.from_pylist(rows, kind)

    raw = found.select("member", "xml").mapInArrow(walked, FOUND)
    filled = lambda c: F.filter(F.transform(c, X.normalize_space), lambda x: x != "")
    title = F.array_sort(F.transform(F.filter(filled("titles"), lambda x: F.contains(F.lower(x), F.lit("code"))), lambda x: F.struct(F.length(x), x.alias("x"))))
    blocks = F.array_distinct(filled("blocks"))
    body = F.when(F.size(blocks) > 0, X.normalize_space(F.array_join(blocks, "\n\n"))).otherwise(X.normalize_space(F.col("whole")))
    rows = raw.select(F.coalesce(F.get(title, 0)["x"], source_of_path(F.col("source_file"))).alias("source_code"), *(F.get(filled(f), 0).alias(f) for f in FIELDS), body.alias("text"), "source_file")
    return rows.where((F.col("text") != "") & (F.col("article_id").isNotNull() | F.col("article_number").isNotNull())).select("article_id", "source_code", "article_number", "etat", "date_debut", "date_fin", "text", "source_file")


def in_force(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("etat") == "VIGUEUR") & (F.col("date_fin") == "2999-01-01"))
