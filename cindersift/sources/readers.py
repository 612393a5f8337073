"""Raw payloads to tables. All of it is untrusted: bad rows are dropped, missing parts stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PROBES
from ..functions.expr import iso_date, number

FACT = "array<struct<start:string,end:string,val:double,fp:string,form:string,filed:string,accn:string>>"
COMPANY_FACTS = f"cik string, entityName string, facts map<string,map<string,struct<units:map<string,{FACT}>>>>"
RECENT = "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,items:array<string>,primaryDocument:array<string>>"
SUBMISSIONS = f"cik string, sic string, sicDescription string, filings struct<recent:{RECENT}>"
OWNERSHIP = (
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,officerTitle:string,isTenPercentOwner:string>>>,"
    "nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,"
    "transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>>>>>,"
    "footnotes struct<footnote:array<struct<_VALUE:string,_id:string>>>"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SUSPENDED = r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+(\d{1,2}),\s+(\d{4})\s+(.{1,150}?)\s+Release No\.\s*(34-\d+)"
#: Names under which the columns of a fails-to-deliver file occur.
FTD_NAMES = {
    "settlement_date": ["settlement date", "settlementdate", "date"], "symbol": ["symbol", "ticker"], "quantity": ["quantity (fails)", "quantity", "fails", "qty", "total fails"],
    "cusip": ["cusip"], "price": ["price"], "issuer": ["description", "issuer name", "issuer", "company name"],
}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a folder as rows: path, value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def universe(payload: DataFrame) -> DataFrame:
    """Listing payloads ``value`` (``fields`` and ``data`` rows) to ticker, cik (ten digits), exchange, name; the last of one ticker wins."""
    parsed = payload.select(F.from_json("value", "fields array<string>, data array<array<string>>").alias("p"))
    rows = parsed.select("p.fields", F.posexplode("p.data").alias("pos", "row"))
    cell = lambda name: F.get("row", (F.array_position("fields", name) - 1).cast("int"))
    good = rows.select("pos", F.upper(F.trim(cell("ticker"))).alias("ticker"), F.trim(cell("cik")).alias("cik"), cell("exchange").alias("exchange"), cell("name").alias("name")).where("ticker <> '' AND cik RLIKE '^[0-9]+$'")
    last = good.groupBy("ticker").agg(F.max_by(F.struct("cik", "exchange", "name"), "pos").alias("s"))
    return last.select("ticker", F.lpad("s.cik", 10, "0").alias("cik"), "s.exchange", "s.name")


def company_facts(payload: DataFrame) -> DataFrame:
    """Fact payloads ``value`` to the long table of facts.

    Units are matched exactly or else by prefix, the first in the payload's order; rows without a value go.
    """
    return facts_of(payload.select(F.from_json("value", COMPANY_FACTS).alias("p")))


def facts_of(parsed: DataFrame) -> DataFrame:
    """Parsed fact payloads ``p`` to the long table of facts."""
    p = parsed.select(F.lpad(F.col("p.cik"), 10, "0").alias("cik"), F.col("p.entityName").alias("entity_name"), F.explode("p.facts").alias("taxonomy", "tags"))
    tags = p.select("cik", "entity_name", "taxonomy", F.explode("tags").alias("tag", "t"))
    units = tags.select("cik", "entity_name", "taxonomy", "tag", F.posexplode(F.map_entries("t.units")).alias("unit_pos", "u"))
    rows = units.select("cik", "entity_name", "taxonomy", "tag", F.col("u.key").alias("unit"), "unit_pos", F.posexplode("u.value").alias("row_pos", "r"))
    return rows.select("cik", "entity_name", "taxonomy", "tag", "unit", "unit_pos", "row_pos", "r.*").where("val IS NOT NULL")


def one_unit(facts: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Facts with the unit of each tag that stands for USD or shares: the exact key, else the first with that prefix."""
    base = F.when(F.col("unit").startswith("USD"), "USD").when(F.col("unit").startswith("shares"), "shares")
    named = facts.withColumn("base", base).where("base IS NOT NULL")
    best = named.groupBy("cik", "taxonomy", "tag", "base").agg(F.min(F.struct((F.col("unit") != F.col("base")).alias("inexact"), "unit_pos", "unit")).alias("b"))
    kept = named.join(best.select("cik", "taxonomy", "tag", "base", F.col("b.unit").alias("unit")), ["cik", "taxonomy", "tag", "base", "unit"])
    return kept.withColumn("unit", F.col("base")).drop("base")


def filings(payload: DataFrame) -> DataFrame:
    """Submission payloads ``value`` to filings in order; short parallel arrays give empty strings."""
    p = payload.select(F.from_json("value", SUBMISSIONS).alias("p")).select(F.lpad(F.col("p.cik"), 10, "0").alias("cik"), *sic("p.sic", "p.sicDescription"), F.col("p.filings.recent").alias("r"))
    rows = p.select("cik", "sic", "sic_sector", F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"r.{n}"), F.array().cast("array<string>")).alias(n) for n in ("form", "filingDate", "accessionNumber", "items", "primaryDocument")])).alias("pos", "f"))
    text = lambda name: F.coalesce(F.col(f"f.{name}"), F.lit(""))
    return rows.select("cik", "pos", text("form").alias("form"), text("filingDate").alias("filing_date"), text("accessionNumber").alias("accession"), text("items").alias("items"), text("primaryDocument").alias("primary_document"), "sic", "sic_sector")


def sic(code: str, description: str) -> list[Column]:
    """Industry code as a number, and the sector: its description or else the code as it is."""
    return [F.trim(code).try_cast("int").alias("sic"), F.coalesce(F.nullif(F.trim(description), F.lit("")), F.nullif(F.trim(code), F.lit(""))).alias("sic_sector")]


def document_name(name: Column) -> Column:
    """A raw document's name without the prefix of its rendered form."""
    return F.substring_index(name, "/", -1)


def form144(filings_: DataFrame) -> DataFrame:
    return filings_.where(F.upper(F.trim("form")).isin("144", "144/A")).select("cik", F.col("filing_date").alias("date"))


def ownership_filings(filings_: DataFrame) -> DataFrame:
    form = F.upper(F.col("form"))
    return filings_.where(form.contains("13D") | form.contains("13G")).select("cik", F.col("accession").alias("filer"), F.col("form").alias("form_type"), F.col("filing_date").alias("date"), "pos", F.lit(None).cast("double").alias("pct"))


def ownership_xml(payload: DataFrame) -> DataFrame:
    """Ownership documents ``cik, accession, value`` to transactions; malformed documents give none.

    A footnote that names a 10b5-1 plan marks all rows of its document; a missing share count or price is 0 in the value.
    """
    d = payload.select("cik", "accession", F.from_xml("value", OWNERSHIP, {"mode": "PERMISSIVE", "rowTag": "ownershipDocument"}).alias("d"))
    plan = F.coalesce(F.exists("d.footnotes.footnote", lambda f: F.lower(F.coalesce(f["_VALUE"], F.lit(""))).contains("10b5-1")), F.lit(False))
    owner = F.get("d.reportingOwner", 0)
    rel = owner["reportingOwnerRelationship"]
    yes = lambda c: F.lower(F.trim(c)).isin("1", "true")
    role = F.coalesce(F.nullif(F.trim(rel["officerTitle"]), F.lit("")), F.when(yes(rel["isOfficer"]), "officer"), F.when(yes(rel["isDirector"]), "director"), F.when(yes(rel["isTenPercentOwner"]), "10% owner"), F.lit(""))
    rows = d.select("cik", "accession", plan.alias("is_10b5_1"), F.trim(owner["reportingOwnerId"]["rptOwnerName"]).alias("insider"), role.alias("role"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    value = lambda path: number(F.col(f"t.transactionAmounts.{path}.value"))
    shares, price = F.coalesce(value("transactionShares"), F.lit(0.0)), F.coalesce(value("transactionPricePerShare"), F.lit(0.0))
    return rows.select("cik", "accession", "insider", "role", F.trim("t.transactionCoding.transactionCode").alias("code"), shares.alias("shares"), (shares * price).alias("value"), F.trim("t.transactionDate.value").alias("date"), "is_10b5_1", F.lit(False).alias("preceded_by_exercise")).where("code <> ''")


def suspensions(payload: DataFrame) -> DataFrame:
    """Suspension pages ``value`` (HTML) to company, date, release; rows with an impossible date go."""
    text = F.regexp_replace(F.regexp_replace("value", r"<[^>]+>", " "), r"\s+", " ")
    parts = [F.regexp_extract_all(text, F.lit(SUSPENDED), F.lit(k)).alias(n) for k, n in ((1, "m"), (2, "d"), (3, "y"), (4, "c"), (5, "r"))]
    rows = payload.select(*parts).select(F.explode(F.arrays_zip("m", "d", "y", "c", "r")).alias("s")).select("s.*")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring("m", 1, 3)))
    date = iso_date(F.concat_ws("-", "y", F.lpad(month.cast("string"), 2, "0"), F.lpad("d", 2, "0")))
    company = F.trim(F.regexp_replace(F.trim("c"), r"^,+|,+$", ""))
    return rows.select(company.alias("company"), date.cast("string").alias("date"), F.col("r").alias("release")).where("date IS NOT NULL")


def fails(lines: DataFrame) -> DataFrame:
    """Fails-to-deliver files as lines ``file, line_no, value`` to records. The first line of each file names the columns."""
    head = lines.where("line_no = 0").select("file", F.transform(F.split(F.lower("value"), r"\|"), lambda c: F.trim(c)).alias("names"))
    rows = lines.where("line_no > 0").join(head, "file").select("file", "line_no", "names", F.split("value", r"\|").alias("cells"))
    def cell(name: str) -> Column:
        return F.coalesce(*[F.trim(F.get("cells", (F.array_position("names", a) - 1).cast("int"))) for a in FTD_NAMES[name]])
    out = rows.select("file", "line_no", *[cell(n).alias(n) for n in FTD_NAMES])
    return out.withColumn("quantity", number(F.col("quantity"))).withColumn("price", number(F.col("price"))).withColumn("symbol", F.upper("symbol")).where("symbol <> '' AND quantity IS NOT NULL")


def ftd_periods(year: int, month: int, back: int = 4) -> list[str]:
    """Names of half-month files to look for, newest first, from the month before."""
    out = []
    for k in range(1, back + 1):
        y, m = divmod(year * 12 + month - 1 - k, 12)
        out += [f"{y}{m + 1:02d}b", f"{y}{m + 1:02d}a"]
    return out


def phrase_hits(docs: DataFrame, phrases: list[str], forms: list[str] | None = None) -> DataFrame:
    """Documents whose text has any of the phrases, with those found in the order of the list."""
    low = F.lower("text")
    hit = F.filter(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(low, p))
    kept = docs if forms is None else docs.where(F.col("form").isin(forms))
    return kept.withColumn("hits", hit).where(F.size("hits") > 0)


def stock_probes(filed: DataFrame, since: Column, until: Column, cik: str | None = None) -> DataFrame:
    """How many filings of each company answer each probe: cik, probe, n_hits.

    ``filed``: cik, form, filing_date, text. Both days count; of all companies unless ``cik`` names one.
    """
    seen = filed.where(F.col("filing_date").between(since, until))
    if cik is not None:
        seen = seen.where(F.col("cik") == cik)
    low = F.lower("text")
    hit = lambda p: F.col("form").isin(p["forms"]) & F.exists(F.array(*[F.lit(x.lower()) for x in p["phrases"]]), lambda x: F.contains(low, x))
    found = F.array_compact(F.array(*[F.when(hit(p), F.lit(name)) for name, p in PROBES.items()]))
    return seen.select("cik", F.explode(found).alias("probe")).groupBy("cik", "probe").agg(F.count(F.lit(1)).alias("n_hits"))


def cascade(keys: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """``keys`` with the row of the first source, in the order given, that has one for the key, and its name as
    ``provider``; where none has, ``failure`` lists all that were asked. Of equal keys of one source the least row counts."""
    union = None
    for place, (name, df) in enumerate(sources.items()):
        part = df.select(key, F.struct(F.lit(place).alias("place"), F.lit(name).alias("provider"), F.struct(*[c for c in df.columns if c != key]).alias("row")).alias("answer"))
        union = part if union is None else union.unionByName(part)
    first = union.groupBy(key).agg(F.min("answer").alias("answer"))
    asked = F.lit("no answer from " + ", ".join(sources))
    return keys.join(first, key, "left").select(*keys.columns, "answer.provider", F.when(F.col("answer").isNull(), asked).alias("failure"), "answer.row.*")


def isolated(payload: DataFrame, schema: str) -> DataFrame:
    """Payloads ``value`` parsed one by one: what could not be read has a ``failure`` and no ``parsed``, and stops no other row."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = payload.withColumn("parsed", parsed)
    bad = F.col("parsed").isNull() | F.col("parsed._bad").isNotNull()
    return rows.withColumn("failure", F.when(bad, F.lit("unreadable payload"))).withColumn("parsed", F.when(~bad, F.col("parsed").dropFields("_bad")))


def search_hits(payload: DataFrame) -> DataFrame:
    """Search answers ``value`` to form, accession and date of each hit, with the fallbacks of either key."""
    schema = "hits struct<hits:array<struct<_id:string,_source:struct<form:string,root_forms:array<string>,file_type:string,adsh:string,accession_no:string,file_date:string>>>>"
    h = payload.select(F.explode(F.from_json("value", schema)["hits"]["hits"]).alias("h"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    s = F.col("h._source")
    return h.select(F.coalesce(text(s["form"]), text(F.get(s["root_forms"], 0)), text(s["file_type"]), F.lit("")).alias("form"), F.coalesce(text(s["adsh"]), text(s["accession_no"]), F.get(F.split("h._id", ":"), 0)).alias("accession"), s["file_date"].alias("file_date"))
