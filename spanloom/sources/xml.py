"""XML formats: mass spectra, biochemical models and search answers. One file is one row in; its parts are rows out."""

from __future__ import annotations

import base64
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SPECTRA = "file string, id int, mslevel int, precursors array<struct<mslevel:int,mz:double,z:double,intensity:double>>, mz array<double>, intensity array<double>, error string"
PARTS = "file string, element string, id string, name string, parent string, attributes map<string,string>, math string"


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def vector(data: ET.Element | None) -> list[float]:
    """A base64 vector of 32- or 64-bit floats in either byte order; its length must be as stated."""
    if data is None:
        return []
    kind = ("<" if data.get("endian", "little") == "little" else ">") + ("f4" if data.get("precision", "32") == "32" else "f8")
    x = np.frombuffer(base64.b64decode(data.text or ""), kind).astype(float)
    if data.get("length") is not None and int(data.get("length")) != len(x):
        raise ValueError("a vector's length isn't as stated")
    return x.tolist()


def _param(e: ET.Element, name: str) -> float | None:
    return next((float(p.get("value")) for p in e.iter() if _bare(p.tag) in ("cvParam", "userParam") and p.get("name") == name), None)


def _spectrum(e: ET.Element) -> tuple:
    find = lambda n: next((x for x in e.iter() if _bare(x.tag) == n), None)
    inst = find("spectrumInstrument")
    pre = [{"mslevel": int(p.get("msLevel", 0)), "mz": _param(p, "MassToChargeRatio"), "z": _param(p, "ChargeState"), "intensity": _param(p, "Intensity")} for p in e.iter() if _bare(p.tag) == "precursor"]
    data = lambda n: next((d for a in e.iter() if _bare(a.tag) == n for d in a.iter() if _bare(d.tag) == "data"), None)
    mz, intensity = vector(data("mzArrayBinary")), vector(data("intenArrayBinary"))
    if len(mz) != len(intensity):
        raise ValueError("vectors of different length")
    return int(e.get("id")), int(inst.get("msLevel")) if inst is not None else None, pre, mz, intensity


def _each(df: DataFrame, fn, schema: str) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for f, x in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True) for r in fn(f, x)]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

    return df.where("content IS NOT NULL").select(F.col("file").cast("string").alias("file"), F.col("content").cast("string").alias("content")).mapInArrow(run, schema)


def mz_data(df: DataFrame) -> DataFrame:
    """Spectra of mzData files (columns file, content); what can't be read is a row with an error."""

    def one(file: str, text: str) -> list[tuple]:
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            return [(file, None, None, None, None, None, f"xml: {e}")]
        out = []
        for e in root.iter():
            if _bare(e.tag) == "spectrum":
                try:
                    out.append((file, *_spectrum(e), None))
                except (ValueError, TypeError) as x:
                    out.append((file, None, None, None, None, None, str(x)))
        return out

    return _each(df, one, SPECTRA)


def sbml(df: DataFrame) -> DataFrame:
    """Parts of SBML models: one row for each compartment, species, parameter, reaction, reference, rule, event and the like, with its parent and the text of its formula."""
    keep = {"model", "compartment", "species", "parameter", "reaction", "speciesReference", "modifierSpeciesReference", "kineticLaw", "functionDefinition", "unitDefinition", "unit", "rateRule", "assignmentRule", "algebraicRule", "initialAssignment", "constraint", "event", "trigger", "delay", "eventAssignment", "compartmentType", "speciesType"}

    def formula(e: ET.Element) -> str:
        tag = _bare(e.tag)
        if tag in ("ci", "cn"):
            return (e.text or "").strip() + "".join(f" {_bare(s.tag)} {(s.tail or '').strip()}" for s in e)
        parts = [formula(c) for c in e]
        if tag == "apply" and parts:
            return f"{parts[0]}({', '.join(parts[1:])})"
        return f"{tag}({', '.join(parts)})" if parts else tag

    def one(file: str, text: str) -> list[tuple]:
        try:
            root = ET.fromstring(text)
        except ET.ParseError as e:
            return [(file, "error", None, str(e), None, {}, None)]
        out, todo = [], [(root, None)]
        while todo:
            e, parent = todo.pop()
            tag = _bare(e.tag)
            if tag in keep:
                math = next((c for c in e if _bare(c.tag) == "math"), None)
                out.append((file, tag, e.get("id"), e.get("name"), parent, {_bare(k): v for k, v in e.attrib.items()}, ", ".join(formula(c) for c in math) if math is not None else None))
                parent = e.get("id") or parent
            todo += [(c, parent) for c in reversed(list(e))]
        return out

    return _each(df, one, PARTS)


def search_answer(xml: Column) -> Column:
    """struct<count, retmax, retstart, ids> of a search service's XML answer."""
    leaf = lambda n: F.xpath_int(xml, F.lit(f"/eSearchResult/{n}"))
    return F.struct(leaf("Count").alias("count"), leaf("RetMax").alias("retmax"), leaf("RetStart").alias("retstart"), F.xpath(xml, F.lit("/eSearchResult/IdList/Id/text()")).alias("ids"))


SUMMARIES = "file string, id string, item string, kind string, value string, error string"
ARTICLES = "file string, pmid bigint, title string, abstract string, error string"
GENES = "file string, locus string, allele string, description string, maploc string, db array<struct<db:string,tag:string>>, error string"
NODES = "file string, owner_kind string, owner string, node int, parent int, position int, operator string, text string, error string"


def _parsed(text: str) -> tuple[ET.Element | None, str | None]:
    try:
        return ET.fromstring(text), None
    except ET.ParseError as e:
        return None, str(e)


def _find(e: ET.Element, tag: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _bare(x.tag) == tag)


def _within(e: ET.Element, tag: str) -> str | None:
    x = next(_find(e, tag), None)
    return None if x is None else "".join(x.itertext()).strip() or None


def summary_answers(df: DataFrame) -> DataFrame:
    """Answers with document summaries: a row for each item of each document, with its declared type; items of a list are rows named by the list's path."""

    def one(file: str, text: str) -> list[tuple]:
        root, fault = _parsed(text)
        out = [(file, None, None, None, None, fault)] if root is None else []
        for doc in _find(root, "DocSum") if root is not None else ():
            ident, todo = _within(doc, "Id"), [(x, "") for x in doc if _bare(x.tag) == "Item"]
            while todo:
                x, path = todo.pop(0)
                name = f"{path}/{x.get('Name')}" if path else x.get("Name")
                inner = [y for y in x if _bare(y.tag) == "Item"]
                todo += [(y, name) for y in inner]
                if not inner:
                    out.append((file, ident, name, x.get("Type"), (x.text or "").strip() or None, None))
        return out

    return _each(df, one, SUMMARIES)


def article_answers(df: DataFrame) -> DataFrame:
    """Answers with articles: number, title and abstract (its parts joined by line ends) of each."""

    def one(file: str, text: str) -> list[tuple]:
        root, fault = _parsed(text)
        if root is None:
            return [(file, None, None, None, fault)]
        whole = lambda e: "".join(e.itertext()).strip()
        return [(file, int(p) if (p := _within(a, "PMID") or "").isascii() and p.isdigit() else None, _within(a, "ArticleTitle"), "\n".join(map(whole, _find(a, "AbstractText"))) or None, None) for a in _find(root, "MedlineCitation")]

    return _each(df, one, ARTICLES)


def gene_answers(df: DataFrame) -> DataFrame:
    """Answers with genes: locus, allele, description, map location and the database links of each gene reference."""

    def one(file: str, text: str) -> list[tuple]:
        root, fault = _parsed(text)
        if root is None:
            return [(file, None, None, None, None, None, fault)]
        link = lambda t: {"db": _within(t, "Dbtag_db"), "tag": _within(t, "Object-id_id") or _within(t, "Object-id_str")}
        return [(file, _within(g, "Gene-ref_locus"), _within(g, "Gene-ref_allele"), _within(g, "Gene-ref_desc"), _within(g, "Gene-ref_maploc"), [link(t) for t in _find(g, "Dbtag")], None) for g in _find(root, "Gene-ref")]

    return _each(df, one, GENES)


def math_nodes(df: DataFrame) -> DataFrame:
    """Formulas of SBML models as trees: a row for each node, numbered within its owner, with its parent and place, the operator or leaf kind, and a leaf's text."""

    def one(file: str, text: str) -> list[tuple]:
        root, fault = _parsed(text)
        if root is None:
            return [(file, None, None, None, None, None, None, None, fault)]
        out = []
        for owner in root.iter():
            for math in (c for c in owner if _bare(c.tag) == "math"):
                n, todo = 0, [(c, None, i) for i, c in reversed(list(enumerate(math)))]
                while todo:
                    e, parent, i = todo.pop()
                    children = list(e)
                    tag = _bare(e.tag)
                    if tag == "apply" and children:  # the first child names what is applied to the others
                        tag, children = _bare(children[0].tag) if _bare(children[0].tag) != "ci" else (children[0].text or "").strip(), children[1:]
                    out.append((file, _bare(owner.tag), owner.get("id") or owner.get("symbol") or owner.get("variable"), n, parent, i, tag, (e.text or "").strip() or None if tag in ("ci", "cn") else None, None))
                    todo += [(c, n, k) for k, c in reversed(list(enumerate(children)))]
                    n += 1
        return out

    return _each(df, one, NODES)


# Typed attributes of the parts of a model.
TYPED = {
    "compartment": {"spatialDimensions": "int", "size": "double", "units": "string", "outside": "string", "constant": "boolean"},
    "species": {"compartment": "string", "initialAmount": "double", "initialConcentration": "double", "substanceUnits": "string", "hasOnlySubstanceUnits": "boolean", "boundaryCondition": "boolean", "charge": "int", "constant": "boolean"},
    "parameter": {"value": "double", "units": "string", "constant": "boolean"},
    "reaction": {"reversible": "boolean", "fast": "boolean"},
    "speciesReference": {"species": "string", "stoichiometry": "double"},
    "modifierSpeciesReference": {"species": "string"},
    "unit": {"kind": "string", "exponent": "int", "scale": "int", "multiplier": "double"},
    "eventAssignment": {"variable": "string"},
}


def typed_parts(parts: DataFrame, kind: str) -> DataFrame:
    """The parts of one kind from :func:`sbml` with typed columns; a value that is missing or not of its type is null."""
    name, ident, parent, attrs, formula = (parts.columns[i] for i in (3, 2, 4, 5, 6))
    cols = (F.col(attrs)[k].try_cast(t).alias(k) for k, t in TYPED[kind].items())
    return parts.where(F.col(parts.columns[1]) == kind).select("file", F.col(ident).alias("id"), F.col(name).alias("name"), F.col(parent).alias("parent"), *cols, F.col(formula).alias("formula"))
