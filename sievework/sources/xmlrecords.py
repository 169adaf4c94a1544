"""XML records: writing, safe reading by path, archives of them, and topic files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What XML 1.0 can't hold.
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def _escaped(c: Column) -> Column:
    clean = F.regexp_replace(c, _CONTROL, "")
    return F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), _escaped(c), F.lit(f"</{name}>"))).otherwise("")


def write() -> Column:
    """The XML record of a study: id, status and conditions."""
    conditions = F.array_join(F.transform(F.filter("conditions", lambda x: x.isNotNull()), lambda x: _element("condition", x)), "")
    return F.concat(
        F.lit("<clinical_study>"), _element("nct_id", F.col("trial_id")), _element("overall_status", F.col("overall_status")),
        F.coalesce(conditions, F.lit("")), F.lit("</clinical_study>"),
    )


def safe(xml: Column) -> Column:
    """XML that declares no type and no entity; null otherwise, since a path would expand them."""
    return F.when(~xml.rlike(r"(?i)<!(DOCTYPE|ENTITY)"), xml)


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def extract(records: DataFrame, key: str, xml: str) -> DataFrame:
    """Fields by path, white space normalised, repeated nodes joined by a blank, and the state of the status field."""
    x = safe(F.col(xml))
    states = F.xpath(x, F.lit("/clinical_study/overall_status"))
    conditions = F.xpath(x, F.lit("/clinical_study/condition/text()"))
    return records.select(
        key, _normal(F.xpath_string(x, F.lit("/clinical_study/nct_id"))).alias("trial_id"),
        _normal(F.xpath_string(x, F.lit("/clinical_study/overall_status"))).alias("overall_status"),
        _normal(F.array_join(conditions, " ")).alias("conditions"),
        F.xpath_int(x, F.lit("count(/clinical_study/condition)")).alias("n_conditions"),
        F.when(F.size(states) == 0, "absent").when(_normal(F.xpath_string(x, F.lit("/clinical_study/overall_status"))) == "", "empty").otherwise("present").alias("status_state"),
    )


#: Fixed value: bytes that a member of an archive may unpack to.
MOST_MEMBER = 10 << 20
_MEMBER = re.compile(r"(?:[\w.-]+/)*NCT\d{8}\.xml\Z")


def _member_issue(archive: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> tuple[str | None, str | None]:
    """The record's id, or what is wrong with a member of an archive."""
    if not _MEMBER.match(info.filename) or ".." in info.filename:
        return None, "unsafe_path"
    if info.flag_bits & 1:
        return None, "encrypted"
    if info.file_size > most:
        return None, "too_large"
    try:
        raw = archive.read(info)
    except (zipfile.BadZipFile, RuntimeError, OSError):
        return None, "damaged"
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw, re.I):
        return None, "declares_entities"
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None, "not_xml"
    found = " ".join((root.findtext("id_info/nct_id") or root.findtext("nct_id") or "").split())
    wanted = info.filename.rpartition("/")[2][:-4]
    if root.tag != "clinical_study":
        return None, "wrong_root"
    return (found, None) if found == wanted else (None, "id_differs_from_name")


def scan_archives(files: DataFrame, most: int = MOST_MEMBER) -> DataFrame:
    """``(archive, member, trial_id, issue)`` of all members of ZIP archives given as ``(path, content)``."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"], part["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    rows.append((name, None, None, "not_an_archive"))
                    continue
                with archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            rows.append((name, info.filename, *_member_issue(archive, info, most)))
            yield pd.DataFrame(rows, columns=["archive", "member", "trial_id", "issue"])

    return files.select("path", "content").mapInPandas(scan, "archive string, member string, trial_id string, issue string")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of all archives below a path; an archive is read by one task."""
    return scan_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path))


def archives_of(records: DataFrame, name: str, xml: str, members: int = 500) -> DataFrame:
    """``(path, content)``: records packed into ZIP archives of about ``members`` each, by the hash of their names."""
    count = max(1, -(-records.count() // members))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, text in sorted(zip(part["member"], part["xml"])):
                archive.writestr(zipfile.ZipInfo(f"{member}.xml"), text)
        return pd.DataFrame({"path": [f"part-{part['part'].iloc[0]}.zip"], "content": [out.getvalue()]})

    named = records.select(F.col(name).alias("member"), F.col(xml).alias("xml")).where("member is not null and xml is not null")
    parts = named.withColumn("part", F.pmod(F.xxhash64("member"), F.lit(count)))
    return parts.groupBy("part").applyInPandas(pack, "path string, content binary")


def validate_corpus(members: DataFrame, judged_ids: DataFrame) -> DataFrame:
    """``(issue, rows)``: member issues, ids that occur twice, and judged ids that no archive holds."""
    good = members.where("issue is null")
    issues = members.where("issue is not null").groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))
    twice = good.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("repeated_id").alias("issue"), F.count(F.lit(1)).alias("rows"))
    missing = judged_ids.select("trial_id").distinct().join(good, "trial_id", "left_anti").agg(F.lit("judged_but_missing").alias("issue"), F.count(F.lit(1)).alias("rows"))
    return issues.unionByName(twice.where("rows > 0")).unionByName(missing.where("rows > 0"))


def load_topics(raw: bytes) -> list[dict]:
    """Topics of an XML file ``topics/topic[@number]``; all issues are raised together."""
    if len(raw) > 2 << 20:
        raise ValueError("the file is larger than 2 MiB")
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw, re.I):
        raise ValueError("the file declares a type or an entity")
    root = ElementTree.fromstring(raw)
    issues, out, seen = [], [], set()
    if root.tag != "topics":
        issues.append(f"root is {root.tag}")
    for place, node in enumerate(root, 1):
        number, text = node.get("number", ""), " ".join("".join(node.itertext()).split())
        if node.tag != "topic":
            issues.append(f"{place}: element {node.tag}")
        elif not re.fullmatch(r"[1-9]\d*", number):
            issues.append(f"{place}: number {number!r}")
        elif number in seen:
            issues.append(f"{place}: number {number} again")
        elif not text:
            issues.append(f"{place}: no text")
        else:
            seen.add(number)
            out.append({"topic_id": number, "text": text, "locator": f"/topics/topic[{place}]"})
    if issues:
        raise ValueError("; ".join(issues))
    return out
