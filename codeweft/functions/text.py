"""Scalar text functions as column expressions."""

from __future__ import annotations

import hmac
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column | str) -> Column:
    t = F.trim(_c(x))
    return F.when(t != "", t)


def first_filled(*xs: Column | str) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*(blank_to_null(x) for x in xs))


def clone_url(x: Column | str) -> Column:
    """One spelling per clone URL: lower case, no trailing slash or ``.git``, ssh as https. Blank gives an empty string."""
    t = F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))
    t = F.regexp_replace(t, "/$", "")
    t = F.regexp_replace(t, "^git@([^:]+):(.*)$", "https://$1/$2")
    return F.regexp_replace(t, r"\.git$", "")


def branch_of(ref: Column | str) -> Column:
    """``refs/heads/x`` -> ``x``; blank -> null."""
    return F.regexp_replace(blank_to_null(ref), "^refs/heads/", "")


def simple_type(t: Column | str) -> Column:
    """``java.util.List<X>[]`` -> ``List``; a text that begins with ``<`` keeps it."""
    t = _c(t)
    no_args = F.when(F.instr(t, "<") > 1, F.substring_index(t, "<", 1)).otherwise(t)
    return F.substring_index(F.trim(F.replace(no_args, F.lit("[]"), F.lit(""))), ".", -1)


def method_id(owner: Column | str, name: Column | str, types: Column) -> Column:
    """``owner#name(simple,...)`` from an array of parameter types."""
    return F.concat(_c(owner), F.lit("#"), _c(name), F.lit("("), F.array_join(F.transform(types, simple_type), ","), F.lit(")"))


def null_sha(x: Column | str) -> Column:
    """True for no commit: null, blank or 40 zeros."""
    x = _c(x)
    return x.isNull() | (F.trim(x) == "") | x.rlike("^0{40}$")


def truncated(x: Column | str, most: int, suffix: str = "\n... [truncated]\n") -> Column:
    x = _c(x)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(suffix))).otherwise(x)


def posix(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def source_root(path: Column | str) -> Column:
    """The folder up to ``src/main/java``, null where there is none."""
    return blank_to_null(F.regexp_extract(posix(path), "^(.*src/main/java)/", 1))


def escaped_html(x: Column | str) -> Column:
    """&, < and > escaped, line feeds as ``<br>`` (a carriage return before one stays); null gives an empty text."""
    t = F.coalesce(_c(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def merged_html(summary: Column | str, report: Column | str) -> Column:
    """A plain summary above an HTML report: the summary escaped and, where both are there, set in a column like the report's; else whichever there is."""
    head, tail = escaped_html(summary), F.coalesce(F.trim(_c(report)), F.lit(""))
    # The table around a summary, as reports have it.
    before = (
        '<table role="presentation" width="100%" cellpadding="0" cellspacing="0" border="0" style="margin:0;padding:0;"><tr><td align="center" style="padding:0 8px 8px 8px;">'
        '<table role="presentation" width="650" cellpadding="0" cellspacing="0" border="0" style="max-width:650px;font-family:Arial,Helvetica,sans-serif;color:#333333;">'
        '<tr><td style="font-size:14px;line-height:1.6;text-align:left;">'
    )
    both = F.concat(F.lit(before), head, F.lit("</td></tr></table></td></tr></table><br>"), tail)
    return F.when((head != "") & (tail != ""), both).when(head != "", head).otherwise(tail)


def signed(body: Column | str, signature: Column | str, secret: str | None) -> Column:
    """Whether ``signature`` is ``sha256=`` and the HMAC-SHA256 of the bytes ``body`` under ``secret``; null or no secret never is."""

    @F.pandas_udf("boolean")
    def check(b: pd.Series, s: pd.Series) -> pd.Series:
        key = (secret or "").encode()
        fit = lambda x, y: bool(key) and x is not None and y is not None and hmac.compare_digest("sha256=" + hmac.new(key, x, "sha256").hexdigest(), y)
        return pd.Series([fit(x, y) for x, y in zip(b, s)], dtype=bool)

    return check(_c(body).cast("binary"), _c(signature))


def html_document(fragment: Column | str) -> Column:
    """A UTF-8 HTML document around a fragment."""
    head = '<!DOCTYPE html><html><head><meta charset="UTF-8"></head><body>'
    return F.concat(F.lit(head), F.coalesce(_c(fragment), F.lit("")), F.lit("</body></html>"))


def from_epoch_ms(ms: Column | str) -> Column:
    """UTC timestamp, cut to whole seconds."""
    return F.timestamp_seconds(F.floor(_c(ms) / 1000))


def depth_from_count(n: Column | str) -> Column:
    """Propagation depth for n nodes: 30 below 20, falling to 20 at 50, 10 beyond; half to even."""
    n = _c(n)
    return F.when(n < 20, 30).when(n > 50, 10).otherwise(F.bround(30 - 10 * (n - 20) / 30.0, 0)).cast("int")


def lines(text: Column | str) -> Column:
    """Lines as a reader yields them: no empty last line after a final break; null text has none."""
    parts = F.split(_c(text), r"\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normal_glob(glob: str | None) -> str:
    """``*.java``, ``glob:*.java`` and ``**/*.java`` all become ``{*.java,**/*.java}``."""
    g = (glob or "").strip()
    g = g.removeprefix("glob:").strip() or "**/*.java"
    if g.startswith("{"):
        return g
    bare = g.removeprefix("**/")
    return f"{{{bare},**/{bare}}}" if "/" not in bare else g


def glob_regex(glob: str) -> str:
    """A path glob (``*``, ``**``, ``?``, classes and braces) as an anchored regular expression."""
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)+" if i == 0 or glob[i - 1] in "/,{" else out + ".*/", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            braces += 1
            out += "(?:"
        elif c == "}" and braces:
            braces -= 1
            out += ")"
        elif c == "," and braces:
            out += "|"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                out += r"\["
            else:
                body = glob[i + 1 : end].replace("\\", "\\\\")
                out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
                i = end
        else:
            out += re.escape(c)
        i += 1
    return "^" + out + "$"
