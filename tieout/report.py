"""Reports of locked evidence: CSV with every cell quoted, JSON, and a plain PDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.evidence import canonical
from tieout.functions import columns as C
from tieout.model import EntitlementRequired, InvalidConfiguration, ResourceLimit
from tieout.operators.numbering import numbered
from tieout.plans.reconcile import Result, with_keys

LINES_PER_PAGE, PDF_BYTES = 52, 32 << 20


def quoted(text: object) -> str:
    return '"' + str("" if text is None else text).replace('"', '""') + '"'


CELLS = ("section", "type", "account", "currency", "left", "right", "difference", "details")
LIMITATION = "Supplied files and recorded decisions only; not bank, accounting, tax, legal or audit assurance."
LINE = 105


def mapping_text(replay: dict) -> str:
    """How a source was read, in one line."""
    parts, m, profile = [f"format {replay['format']}", f"parser {replay['parser_version']}"], replay["mapping"], replay["profile"]
    if m:
        at = lambda name: "default" if m[name] is None else m[name]
        parts += [f"date[{m['date']}] amount[{m['amount']}]", f"account[{at('account')}] currency[{at('currency')}]", f"dateOrder {m['date_order']} decimal {m['decimal']}"]
    else:
        parts += [f"dateOrder {profile['date_order']} decimal {profile['decimal']}"]
        parts += [f"{label} {profile[k]}" for label, k in (("defaultAccount", "account"), ("defaultCurrency", "currency")) if profile[k]]
    if replay["worksheet"]:
        parts.append(f"worksheet {replay['worksheet']}")
    if replay["balances"]:
        parts.append(f"balanceOverrides {len(replay['balances'])}")
    return "; ".join(parts)


def rows(evidence: dict, entity: str, imported_at: dict[str, str] | None = None) -> list[dict[str, str]]:
    """The report line by line: summary, metadata, sources, totals, matches, exceptions, decisions, by the names of ``CELLS``."""
    m, many, when = evidence["manifest"], " | ".join, imported_at or {}
    job, result = m["job"], m["result"]
    out = [{"section": "summary", "type": result["state"], "details": entity}]
    facts = {"job": job["id"], "mode": job["mode"], "period": " to ".join(job["period"]), "lockedAt": m["locked_at"], "engineVersion": m["engine"], "limitation": LIMITATION}
    out += [{"section": "metadata", "type": k, "details": v} for k, v in facts.items()]
    for s in sorted(job["sources"], key=lambda s: s["filename"]):
        told = [s["filename"], s["sha256"], f"{s['bytes']} bytes", mapping_text(s["replay"]), when.get(s["source_id"], "not recorded")]
        out.append({"section": "source", "type": s["role"], "details": many(told)})
    shown = lambda x: x["canonical"] if isinstance(x, dict) else x
    out += [{"section": "total", "type": t["kind"], **{k: shown(t[k]) for k in ("account", "currency", "left", "right", "difference")}} for t in result["totals"]]
    out += [{"section": "match", "type": x["kind"], "left": x["left_locator"], "right": x["right_locator"]} for x in result["matches"]]
    out += [{"section": "exception", "type": x["kind"], "left": many(x["left_locators"]), "right": many(x["right_locators"]), "details": x["detail"]} for x in result["exceptions"]]
    out += [{"section": "decision", "type": "approved" if d["approved"] else "unresolved", "details": many([d["exception_key"], d["explanation"]])} for d in job["decisions"]]
    return out


_BETWEEN = " | "


def report_table(spark: SparkSession, result: Result, entity: str, facts: dict[str, str], sources: list[dict[str, str]] = (), decisions: DataFrame | None = None) -> DataFrame:
    """``seq`` (from 0, without holes), ``section``, ``type`` and ``line`` (eight quoted cells) of the report of a result of any size: the header, then
    summary, metadata, sources (``role``, ``filename``, ``details``), totals, matches, exceptions and decisions, each in its order.

    Lines are numbered from counts of ranges; what orders them names all their cells, so the numbers follow from the rows alone.
    """
    empty, text = F.lit(""), lambda c: F.coalesce(C.amount_text(F.col(c)), F.lit(""))

    def part(df: DataFrame, section: str, order: list[Column], /, **cells: Column) -> DataFrame:
        made = {"section": F.lit(section)} | cells
        keys = [k.cast("string") for k in order] + [empty] * (5 - len(order))
        return df.select(F.lit(list(_SECTIONS).index(section)).alias("rank"), *[k.alias(f"k{n}") for n, k in enumerate(keys)], *[F.coalesce(made.get(c, empty), empty).alias(c) for c in CELLS])

    told = [("summary", 0, result.state, entity), *(("metadata", k, name, value) for k, (name, value) in enumerate(facts.items()))]
    few = spark.createDataFrame(told, "section string, k int, type string, details string")
    files = spark.createDataFrame([(s["filename"], s["role"], s["details"]) for s in sources], "filename string, role string, details string")
    joined = lambda c: F.array_join(c, _BETWEEN)
    parts = [
        part(spark.range(1), "section", [], **{c: F.lit(c) for c in CELLS}),
        *[part(few.filter(F.col("section") == s), s, [F.format_string("%03d", "k")], type=F.col("type"), details=F.col("details")) for s in ("summary", "metadata")],
        part(files, "source", [F.col("filename"), F.col("role")], type=F.col("role"), details=F.concat_ws(_BETWEEN, "filename", "details")),
        part(result.totals, "total", [F.col("account"), F.col("currency")], type=F.col("kind"), account=F.col("account"), currency=F.col("currency"), left=text("left"), right=text("right"), difference=text("difference")),
        part(result.matches, "match", [F.col("left_locator"), F.col("right_locator"), F.col("kind")], type=F.col("kind"), left=F.col("left_locator"), right=F.col("right_locator")),
        part(result.exceptions, "exception", [F.col("kind"), *[F.array_join(c, "") for c in ("left_locators", "right_locators", "source_fingerprints")], F.col("detail")], type=F.col("kind"), left=joined("left_locators"), right=joined("right_locators"), details=F.col("detail")),
    ]
    if decisions is not None:
        parts.append(part(decisions, "decision", [F.col("exception_key")], type=F.when(F.col("approved"), "approved").otherwise("unresolved"), details=F.concat_ws(_BETWEEN, "exception_key", "explanation")))
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = reduce(DataFrame.unionByName, parts).withColumn("line", F.concat_ws(",", *map(quote, CELLS)))
    slim = lines.select("rank", *[f"k{n}" for n in range(5)], "section", "type", "line")
    return numbered(slim, "rank", *[f"k{n}" for n in range(5)], "line", keep=("section", "type", "line")).select("seq", "section", "type", "line")


#: In the order of the report; the header's line has their column's name.
_SECTIONS = ("section", "summary", "metadata", "source", "total", "match", "exception", "decision")


def write_report(lines: DataFrame, path: str) -> None:
    """The lines as text files under ``path`` whose names are in the order of their lines, so that they read as one report one after the other."""
    ordered = lines.repartitionByRange("seq").sortWithinPartitions("seq").select("line")
    ordered.write.option("lineSep", "\r\n").mode("errorifexists").text(path)


def comparison(result: Result, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """What a reviewer sees side by side: matches as pairs, then the rows that exceptions name, first with first (``kind``, and ``locator``, ``amount`` and
    ``text`` of either side). Locators of balances have no row and are left out. With one side and nothing to show, its rows are listed
    as ``statement``."""
    result = result.unordered()
    zipped = result.exceptions.select("kind", F.explode(F.arrays_zip("left_locators", "right_locators")).alias("x")).select("kind", F.col("x.left_locators").alias("left_locator"), F.col("x.right_locators").alias("right_locator"))
    shown = result.matches.select("kind", "left_locator", "right_locator").unionByName(zipped)
    of = lambda df, s: df.select(F.col("locator").alias(f"{s}_locator"), F.lit(True).alias(f"{s}_there"), F.col("amount").alias(f"{s}_amount"), F.col("description").alias(f"{s}_text"))
    names = ("kind", "left_locator", "right_locator", "left_amount", "right_amount", "left_text", "right_text")
    if right is not None:
        both = shown.join(of(left, "left"), "left_locator", "left").join(of(right, "right"), "right_locator", "left")
        return both.filter("left_there or right_there").select(*names)
    none = [F.lit(None).cast(left.schema["amount"].dataType).alias("right_amount"), F.lit(None).cast("string").alias("right_text")]
    held = shown.join(of(left, "left"), "left_locator").select("*", *none).select(*names)
    if held.limit(1).count():
        return held
    return of(left, "left").select("*", F.lit("statement").alias("kind"), F.lit(None).cast("string").alias("right_locator"), *none).select(*names)


def explained(exceptions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Exceptions with their key and, where there is a decision on it, its ``explanation`` and whether it is ``approved``."""
    return with_keys(exceptions).join(decisions.select("exception_key", "explanation", "approved"), "exception_key", "left")


def pack(record: dict, entity: str, imported_at: dict[str, str] | None = None, header: str | None = None, tier: str = "free") -> dict[str, object]:
    """The reports of a locked revision of the store; a header of one's own needs the tier ``accountant``."""
    entity, header = entity.strip(), (header or "").strip()
    if record["state"] != "locked":
        raise InvalidConfiguration("reports need a locked job")
    if not entity:
        raise InvalidConfiguration("reports need the entity's name")
    if header and tier != "accountant":
        raise EntitlementRequired("accountant")
    evidence = record["content"]
    base = f"reconciliation-{evidence['manifest']['job']['period'][1]}-{evidence['manifest']['job']['id'][:8]}"
    return {"base": base, "pdf": pdf_report(evidence, entity, imported_at, header), "csv": csv_report(evidence, entity, imported_at), "json": json_report(evidence)}


def csv_report(evidence: dict, entity: str, imported_at: dict[str, str] | None = None) -> str:
    lines = [dict(zip(CELLS, CELLS, strict=True)), *rows(evidence, entity, imported_at)]
    return "".join(",".join(quoted(r.get(c)) for c in CELLS) + "\r\n" for r in lines)


def json_report(evidence: dict) -> str:
    return canonical(evidence["manifest"])


def pdf_report(evidence: dict, entity: str, imported_at: dict[str, str] | None = None, header: str = "") -> bytes:
    """52 lines a page, long ones wrapped; what is not printable ASCII shows as a question mark."""
    told = [*([header] if header else []), f"Evidence {evidence['id']}", f"Manifest SHA-256 {evidence['sha256']}"]
    told += [" ".join(str(r[c]) for c in CELLS if r.get(c) not in (None, "")) for r in rows(evidence, entity, imported_at)]
    texts = ["".join(c if " " <= c <= "~" else "?" for c in t) for t in told]
    lines = [("    " if k else "") + t[k : k + LINE] for t in texts for k in range(0, max(1, len(t)), LINE)]
    pages = [lines[k : k + LINES_PER_PAGE] for k in range(0, len(lines), LINES_PER_PAGE)] or [[]]
    escape = lambda t: t.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for k, page in enumerate(pages):
        body = "BT /F1 9 Tf 40 800 Td 14 TL " + " ".join(f"({escape(t)}) Tj T*" for t in page) + " ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>", f"<< /Length {len(body)} >>\nstream\n{body}\nendstream"]
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects, start=1):
        places.append(len(out))
        out += f"{k} 0 obj\n{o}\nendobj\n".encode()
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    out, start = out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}".encode(), len(out)
    out += f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    if len(out) > PDF_BYTES:
        raise ResourceLimit("the report's size")
    return out
