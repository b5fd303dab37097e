"""Functions paired with their documentation.

Every file is read once into declarations, which are written down. They form
a symbol table across files, keyed by ``owner#name(normalised parameter
types)``: a documented declaration without a body (interface, abstract class)
is joined with the definition of the same overload in the nearest subtypes of
its owner, so that its pair gets the code that implements it. Filtering by
documentation comes last.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut
from codeweft.sources import javaparse as J

SCHEMA = (
    "path string, repo_id string, kind string, method_id string, signature string, name string, owner string, overload string, supers array<string>, "
    "has_body boolean, documented boolean, doc string, code string, code_key string"
)

# Words that stand in for documentation or say no more than that there is a method.
_FILLER = frozenset(
    """todo fixme tbd tba tbc xxx hack placeholder auto autogenerated generated stub method function constructor ctor procedure no not none null n a na
    description descriptions documentation documented docs doc javadoc comment comments add missing to be done available yet pending write fill in later
    empty undocumented provided given here nothing say self explanatory automatically created template the an of this that for and or with by is are it its
    as on at from value values returns return returned get gets set sets getter setter new instance class object param params parameter parameters result
    default simple see also please document describe describes implement implements implementation called when wip soon
    noch dokumentieren dokumentiert keine keine beschreibung fehlt folgt siehe methode der die das ein eine automatisch erzeugt erzeugte platzhalter zu
    pendiente sin descripcion descripción documentar por hacer metodo método el la los las un una de del generado automáticamente véase ver
    à faire documenter sans description voir méthode le les""".split()
)
_CJK_FILLER = re.compile("待补充|待完善|待定|待办|暂无(?:说明|描述|注释|文档)?|无(?:说明|描述|注释)|(?:方法|函数|构造)(?:说明|描述)?|说明|描述|注释|文档|自动生成(?:的)?(?:方法)?(?:存根|桩)?|补充|见|参见|请|的|此|该")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
_REFERENCE = re.compile(r"(?im)^\s*(?:\(?(?:non-javadoc|see|see also|refer to|as specified by|specified by|description copied from|copied from|siehe|véase|ver|voir|参见|见|请参阅)\b[^.\n。]*[.。)]?\s*)")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\dA-Za-z_]+")


def main_text(doc: str) -> str:
    """The text of a doc comment before its first block tag, without markup."""
    body = doc[3:-2] if doc.endswith("*/") else doc[3:]
    lines = [re.sub(r"^\s*\*+(?= |\t|$|[^\s*/])", "", x.rstrip("\r")) for x in body.split("\n")]
    kept = []
    for x in lines:
        if re.match(r"\s*@\w", x):
            break
        kept.append(x)
    t = "\n".join(kept)
    t = re.sub(r"(?is)<pre\b.*?(?:</pre>|\Z)|<!--.*?(?:-->|\Z)", " ", t)
    t = re.sub(r"(?is)\{@inheritdoc\s*\}", " ", t)
    t = re.sub(r"(?is)\{@snippet\b.*?\}\s*\}|\{@snippet\b.*?\}", " ", t)
    t = re.sub(r"(?s)\{@(?:link|linkplain|code|literal|value|index|summary|return)\b\s*([^{}]*)\}", r"\1", t)
    t = re.sub(r"<\s*/?\s*[A-Za-z][^<>]*>", " ", t)
    t = html.unescape(t).replace("\xa0", " ")
    return "\n".join(y for x in t.split("\n") if (y := " ".join(x.split())))


def _parts(*names: str) -> set[str]:
    out: set[str] = set()
    for n in names:
        for p in _PART.findall(n):
            out.add(p.lower())
        out.add(n.lower())
    return out


def _stem(w: str) -> str:
    for end in ("'s", "ings", "ing", "ies", "ied", "ers", "er", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 4 and w[-1] == w[-2]:
        w = w[:-1]
    return w.rstrip("e")


def says_something(text: str, d: J.Decl) -> bool:
    """Whether ``text`` states something that the declaration ``d`` does not.

    Filler words, references elsewhere and words of the declaration (parts of
    its name, owner, parameters and types, in any inflection) don't count; two
    further words, or four further characters of a script without blanks, do.
    """
    rest = _REFERENCE.sub(" ", text)
    if len(_CJK.findall(_CJK_FILLER.sub("", rest))) >= 4:
        return True
    own = {_stem(p) for p in _parts(d.name, d.owner.rpartition(".")[2], d.returns, *(x for p in d.params for x in p))}
    words = {_stem(w) for w in (x.lower() for x in _WORD.findall(_CJK.sub(" ", rest))) if w not in _FILLER and len(w) > 1}
    return len(words - own) >= 2


def _declared(unit: J.Unit, text: str) -> Iterator[tuple]:
    supers = {d.name: list(dict.fromkeys(c for _, s in d.supers for c in J.candidates(unit, s, d.owner))) for d in unit.decls if d.kind == "type"}
    for name, above in supers.items():
        if above:
            yield ("type", None, None, name, name, None, above, False, False, None, None, None)
    for d in unit.decls:
        if d.kind != "method":
            continue
        overload = f"{d.name}({','.join(J.simple_type(t) for t, _ in d.params)})"
        doc = main_text(d.doc) if d.doc else None
        code = text[d.start : d.end]
        yield (
            "method", f"{d.owner}#{overload}", J.signature(d), d.name, d.owner, overload, supers.get(d.owner, []), d.has_body,
            bool(doc) and says_something(doc, d), doc, code, hashlib.md5(code.encode("utf-8", "replace")).hexdigest(),
        )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for path, repo, content in zip(b["path"], b["repo_id"], b["content"]):
            if isinstance(content, str) and content:
                rows += [(path, repo, *x) for x in _declared(J.parse(content, want_calls=False), content)]
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=cols)
                rows = []
        yield pd.DataFrame(rows, columns=cols)


def declarations(files: DataFrame) -> DataFrame:
    """Every method and constructor declared in the Java files of (path, repo_id, content), and every type with supertypes.

    Null or empty content declares nothing, a null path is no Java file.
    """
    java = files.where(F.col("path").endswith(".java") & F.col("content").isNotNull()).select("path", "repo_id", "content")
    return java.mapInPandas(_read, SCHEMA)


#: Levels of subtypes that are searched for a definition; deeper ones than any class has, so that cycles end.
MOST_LEVELS = 64


def definitions(bare: DataFrame, methods: DataFrame, links: DataFrame) -> DataFrame:
    """(method_id, found): the definition of each declaration without a body, in the nearest subtypes that have one.

    ``bare``: (method_id, owner, overload); ``methods``: (method_id, path,
    code) of the definitions; ``links``: (sub, super). Of the definitions on
    the nearest level the smallest (path, code) is taken. Definitions are
    reduced to one per key before the join, so an overload defined a million
    times weighs no more than one. What has none in any subtype has no row.
    """
    table = methods.groupBy("method_id").agg(F.min(F.struct("path", "code")).alias("found"))
    below = links.select(F.col("super").alias("at"), "sub").distinct()
    front = bare.select("method_id", "overload", F.col("owner").alias("at")).distinct()
    out: list[DataFrame] = []
    for _ in range(MOST_LEVELS):
        step = front.join(below, "at").select("method_id", "overload", F.col("sub").alias("at"))
        if out:
            step = step.distinct()
        step = cut(step.join(table.withColumnRenamed("method_id", "key"), F.concat_ws("#", "at", "overload") == F.col("key"), "left").drop("key"))
        got = step.where("found is not null").groupBy("method_id").agg(F.min("found").alias("found"))
        out.append(got)
        front = step.where("found is null").drop("found").join(got, "method_id", "left_anti")
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def pairs(files: DataFrame) -> DataFrame:
    """Code-description pairs: (path, repo_id, method_id, signature, doc, code, code_path).

    One row per documented declaration of a file; several scans of a path with
    the same text give one row, with different texts one row each. ``code`` is
    the definition: the declaration itself if it has a body, else what
    ``definitions`` finds in the subtypes of its owner, else the bare
    declaration. ``code_path`` says where it stands. A pair without code is none.
    """
    d = declarations(files)
    # What takes part: declarations with a comment, definitions in types that have supertypes, and the links of those.
    d = cut(d.where("kind = 'type' or doc is not null or has_body and size(supers) > 0").drop("name", "code_key"))
    links = d.where("kind = 'type'").select(F.col("owner").alias("sub"), F.explode("supers").alias("super"))
    told = d.where("kind = 'method' and doc is not null")
    found = definitions(told.where("not has_body and documented"), d.where("has_body and size(supers) > 0").select("method_id", "path", "code"), links)
    # All declarations with a comment join, so that keys stay unique and spread; one with a body keeps its own. Trivial comments go afterwards.
    both = told.join(found, "method_id", "left").withColumn("other", F.when(~F.col("has_body"), F.col("found")))
    both = both.select("path", "repo_id", "method_id", "signature", "doc", "documented", F.coalesce("other.code", "code").alias("code"), F.coalesce("other.path", "path").alias("code_path"))
    return both.where("documented and code <> ''").drop("documented").distinct()


def symbol_table(files: DataFrame) -> DataFrame:
    """Overloads per owner and name across all files: how often declared, defined and documented."""
    return declarations(files).where("kind = 'method'").groupBy("owner", "name", "overload").agg(
        F.countDistinct("path").alias("n_files"), F.count_if("has_body").alias("n_definitions"), F.count_if("documented").alias("n_documented"), F.countDistinct("code_key").alias("n_texts")
    )
