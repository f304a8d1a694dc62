"""Distilling message bodies: HTML and quoted-printable to plain prose.

Everything but the decoding of entities and of quoted-printable runs is a native expression;
those two are Arrow UDFs behind a cheap native test, so that rows without them never leave the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

INVISIBLE = (0x00AD, 0x034F, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)
INVISIBLE_TEXT = "".join(map(chr, INVISIBLE))

# Named entities and what they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ",
    "mdash": "—", "ndash": "–", "hellip": "…",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "sbquo": "‚", "bdquo": "„", "laquo": "«", "raquo": "»",
    "deg": "°", "euro": "€", "pound": "£", "cent": "¢", "yen": "¥", "sect": "§", "para": "¶", "dagger": "†", "permil": "‰", "prime": "′",
    "shy": "­", "zwnj": "‌", "zwj": "‍", "lrm": "‎", "rlm": "‏",
}

BLOCKS = "p|div|tr|li|h[1-6]|table|ul|ol|blockquote|section|article|header|footer"


def strip_invisibles(c: Column) -> Column:
    return F.translate(c, INVISIBLE_TEXT, "")


def looks_quoted_printable(c: Column) -> Column:
    return c.rlike(r"=\r?\n|(?:=[0-9A-Fa-f]{2}){2,}")


def decode_qp_text(text: str) -> str:
    joined = re.sub(r"=\r?\n", "", text)
    return re.sub(r"(?:=[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8", "replace"), joined)


def _code_point(code: int) -> str:
    return chr(code) if 0 <= code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else ""


def decode_entity_text(text: str) -> str:
    text = re.sub(r"(?i)&#x([0-9a-f]+);", lambda m: _code_point(int(m[1], 16)), text)
    text = re.sub(r"&#([0-9]+);", lambda m: _code_point(int(m[1])), text)
    text = re.sub(r"&([A-Za-z]+);", lambda m: ENTITIES.get(m[1].lower(), m[0]), text)
    return text.translate(dict.fromkeys(INVISIBLE))


@pandas_udf(StringType())
def _qp_udf(s: pd.Series) -> pd.Series:
    return s.map(decode_qp_text, na_action="ignore")


@pandas_udf(StringType())
def _entity_udf(s: pd.Series) -> pd.Series:
    return s.map(decode_entity_text, na_action="ignore")


def decode_quoted_printable(c: Column) -> Column:
    return F.when(c.contains("="), _qp_udf(F.when(c.contains("="), c))).otherwise(c)


def maybe_decode_quoted_printable(c: Column) -> Column:
    hit = looks_quoted_printable(c)
    return F.when(hit, _qp_udf(F.when(hit, c))).otherwise(c)


#: Entities of the common set, decoded without Python: & comes last, so that nothing is decoded twice.
COMMON = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))


def decode_entities(c: Column) -> Column:
    rare = c.rlike(r"(?i)&(?!(?:lt|gt|quot|apos|nbsp);)(?:#x[0-9a-f]+|#[0-9]+|[a-z]+);")
    plain = c
    for name, value in COMMON[:-1]:
        plain = F.regexp_replace(plain, f"(?i)&{name};", value)
    return F.when(rare, _entity_udf(F.when(rare, c))).otherwise(strip_invisibles(plain))


def strip_padding_entities(c: Column) -> Column:
    """Only invisible entities go; visible ones stay as they are."""
    names = "|".join(sorted(k for k, v in ENTITIES.items() if v in INVISIBLE_TEXT))
    decimal = "|".join(f"0*{x}" for x in INVISIBLE)
    hexed = "|".join(f"0*{x:x}" for x in INVISIBLE)
    return strip_invisibles(F.regexp_replace(c, f"(?i)&(?:#x(?:{hexed})|#(?:{decimal})|{names});", ""))


def html_to_text(c: Column, decode: bool = True) -> Column:
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "head", "title"):
        c = F.regexp_replace(c, rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?i)<\s*br\s*/?\s*>", "\n")
    c = F.regexp_replace(c, rf"(?i)<\s*/\s*(?:{BLOCKS})\s*>", "\n")
    c = F.regexp_replace(c, rf"(?i)<\s*(?:{BLOCKS})(?![A-Za-z0-9_])[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    return decode_entities(c) if decode else c


# Lines that end the prose. Word bounds are ASCII ones.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
STOPS = (
    rf"^\s*On{_R}.*{_L}wrote:\s*$",
    r"^\s*-{2,}\s*Original Message\s*-{2,}\s*$",
    r"^\s*From:\s.+$",
    r"^--\s*$",
    rf"{_L}unsubscribe{_R}",
    rf"{_L}update (your )?(email )?preferences{_R}",
    rf"{_L}manage (your )?(email )?(subscription|preferences){_R}",
    rf"{_L}view (this email )?in (your )?browser{_R}",
    rf"{_L}you (are )?receiv(e|ing) this (email|message){_R}",
    rf"{_L}sent to you by{_R}",
    rf"^\s*©\s*[0-9]{{4}}{_R}",
    rf"{_L}all rights reserved{_R}",
)


def deboilerplate(c: Column) -> Column:
    """Lines up to the first quote header, signature or footer, without quoted ones."""
    lines = F.split(c, "\n")
    marks = F.transform(lines, lambda x, i: F.when(x.rlike("(?i)" + "|".join(f"(?:{p})" for p in STOPS)), i))
    first = F.array_min(marks)
    head = F.when(first.isNotNull(), F.slice(lines, 1, first)).otherwise(lines)
    return F.array_join(F.filter(head, lambda x: ~x.rlike(r"^\s*>+")), "\n")


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\x{00A0}]+", " ")
    c = F.regexp_replace(c, r"(?m)^ +| +$", "")
    return F.btrim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \n\t\r ﻿"))


def distill(text: Column, html: Column) -> Column:
    """The plain text if it is not blank, else the HTML, as prose."""
    has_text = F.coalesce(text.rlike(r"[^\s\x{00A0}\x{FEFF}]"), F.lit(False))
    raw = F.when(has_text, strip_padding_entities(maybe_decode_quoted_printable(F.when(has_text, text)))).otherwise(html_to_text(maybe_decode_quoted_printable(F.when(~has_text, html))))
    return normalize_whitespace(deboilerplate(F.coalesce(raw, F.lit(""))))


def meaningful_length(c: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)&(?:[a-z]+|#[0-9]+|#x[0-9a-f]+);", "")
    return F.length(F.regexp_replace(strip_invisibles(bare), r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", ""))


def is_image_only(body: Column, candidates: Column, threshold: int = 200) -> Column:
    return (candidates > 0) & (meaningful_length(body) < threshold)
