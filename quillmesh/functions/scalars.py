"""Scalar functions as native Column expressions."""

from __future__ import annotations

import base64
import calendar
import datetime as dt
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JavaScript's white space as a regular-expression class body.
JS_SPACE = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Suffixes of two labels under which a brand has its own label.
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "ac.uk", "gov.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "net.nz", "org.nz", "govt.nz",
    "co.jp", "or.jp", "ne.jp", "co.kr", "or.kr", "com.cn", "com.hk", "com.sg", "com.tw",
    "com.br", "com.mx", "com.ar", "com.co",
    "co.za", "com.tr", "co.in", "com.ua",
]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


#: The characters of JS_SPACE.
JS_SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def filled(c: Column) -> Column:
    """`blank_to_null` of what is dear to compute: c is evaluated once."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null without one; of groups that cannot be empty. c is evaluated once."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JS_SPACES))


# --- addresses and domains


def extract_address(c: Column) -> Column:
    """The first address inside the first <...>, else in the whole value; lower case; null if none."""
    return F.lower(found(F.coalesce(found(c, "<([^>]+)>", 1), c), r"[^\s<>@]+@[^\s<>@]+"))


def display_name(c: Column) -> Column:
    """Text before '<', trimmed, one outer quote stripped at each side; null if empty."""
    before = F.when(F.instr(c, "<") > 1, js_trim(F.substring_index(c, "<", 1)))
    return filled(js_trim(F.regexp_replace(before, "^[\"']|[\"']$", "")))


def split_recipients(c: Column) -> Column:
    """Plain comma split, trimmed, empty parts dropped; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), js_trim), lambda x: x != "")


def split_addresses(c: Column) -> Column:
    """Split on commas that an address still follows."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ",(?=[^,]*@)"), js_trim), lambda x: x != "")


def host_of(c: Column) -> Column:
    """What follows the last @, lower case; null without @ or with nothing after it."""
    return filled(F.lower(js_trim(F.regexp_extract(c, "@([^@]*)$", 1))))


def registrable_domain(c: Column) -> Column:
    """The brand's domain: the last two labels, or three under a two-label suffix."""
    host = F.regexp_replace(F.substring_index(F.lower(js_trim(c)), ":", 1), r"\.$", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    last_two = F.array_join(F.slice(labels, -2, 2), ".")
    out = F.when(n <= 2, F.array_join(labels, ".")).when(last_two.isin(TWO_LABEL_SUFFIXES), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(last_two)
    return blank_to_null(out)


# --- classification


def classify_category(labels: Column) -> Column:
    has = lambda x: F.array_contains(labels, x)
    return (
        F.when(has("CATEGORY_PERSONAL"), "personal").when(has("CATEGORY_SOCIAL"), "social").when(has("CATEGORY_PROMOTIONS"), "promotions")
        .when(has("CATEGORY_UPDATES"), "updates").when(has("CATEGORY_FORUMS"), "forums").when(has("INBOX"), "primary")
    )


def classify_is_list(headers: Column) -> Column:
    """A List-Id or List-Unsubscribe header with a value, were it empty; names in any case."""
    return F.coalesce(F.exists(F.map_entries(headers), lambda e: F.lower(e["key"]).isin("list-id", "list-unsubscribe") & e["value"].isNotNull()), F.lit(False))


def classify_direction(labels: Column, from_address: Column, own: Column) -> Column:
    """sent with a SENT label or from one of the account's own addresses (an array)."""
    return F.when(F.coalesce(F.array_contains(labels, "SENT"), F.lit(False)) | F.coalesce(F.array_contains(own, from_address), F.lit(False)), "sent").otherwise("received")


def flag(labels: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(labels, name), F.lit(False)).cast("int")


# --- text projections


def project_body(snippet: Column, body: Column, summary: Column) -> Column:
    return blank_to_null(F.concat_ws("\n", *map(blank_to_null, (snippet, body, summary))))


def project_recipients(to: Column, cc: Column) -> Column:
    return blank_to_null(F.concat_ws(" ", blank_to_null(to), blank_to_null(cc)))


def compact_snippet(c: Column, limit: int = 160) -> Column:
    flat = js_trim(F.regexp_replace(c, f"[{JS_SPACE}]+", " "))
    return blank_to_null(F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat))


def message_ref(account: Column, message_id: Column) -> Column:
    return F.concat(account, F.lit(":"), message_id)


def parse_ref(c: Column) -> Column:
    """struct(account, id), split at the first colon; null unless both have text."""
    parts = F.split(c, ":", 2)
    return F.when((F.size(parts) == 2) & (parts[0] != "") & (F.get(parts, 1) != ""), F.struct(parts[0].alias("account"), F.get(parts, 1).alias("id")))


def safe_filename(c: Column) -> Column:
    """Every other character as an underscore, 160 characters at most."""
    return F.coalesce(blank_to_null(F.substring(F.regexp_replace(c, r"[^a-zA-Z0-9._-]", "_"), 1, 160)), F.lit("attachment.bin"))


def provider_url(stored: Column, message_id: Column) -> Column:
    return F.coalesce(blank_to_null(stored), F.concat(F.lit("https://mail.google.com/mail/u/0/#all/"), message_id))


def render_labels(labels: Column, names: Column) -> Column:
    """Label ids as names by a map; unknown ids pass through."""
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(names, x), x))


# --- numbers


def saturate(count: Column, half: float) -> Column:
    return F.when(count <= 0, F.lit(0.0)).otherwise(count / (count + F.lit(float(half))))


def round2(c: Column) -> Column:
    """Half towards plus infinity, as JavaScript's Math.round."""
    return F.floor(c * 100 + 0.5) / F.lit(100.0)


def read_rate(read: Column, received: Column) -> Column:
    return F.when(received > 0, round2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(read.cast("double"), received)))))


def suggest_action(score: Column, is_list: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 2.0, "important").when(is_list | (score <= -0.5), "muted").otherwise("none")


# --- driver-side values


def parse_keywords(text: str) -> list[str]:
    seen: dict[str, str] = {}
    for word in (w.strip() for w in text.split(",")):
        if word:
            seen.setdefault(word.lower(), word)
    return list(seen.values())


UNIT_MS = {"mo": 30 * 86_400_000, "d": 86_400_000, "w": 7 * 86_400_000, "h": 3_600_000, "m": 60_000}


def parse_since(text: str, now_ms: int) -> int:
    """Epoch milliseconds of a relative (1d, 2w, 12h, 1mo, 30m) or ISO time."""
    if match := re.fullmatch(r"(\d+)(mo|d|w|h|m)", text.strip()):
        return now_ms - int(match[1]) * UNIT_MS[match[2]]
    try:
        at = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"not a time: {text!r}") from e
    return int((at if at.tzinfo else at.replace(tzinfo=dt.UTC)).timestamp() * 1000)


def minus_months(now: dt.datetime, months: int) -> dt.datetime:
    """Calendar months back in UTC; a day the month lacks runs over into the next one."""
    index = now.year * 12 + now.month - 1 - months
    first = now.replace(year=index // 12, month=index % 12 + 1, day=1)
    return first + dt.timedelta(days=now.day - 1)


def window_cutoff(months: int, now: dt.datetime) -> int | None:
    return None if not months else int(minus_months(now, months).timestamp() * 1000)


# An account's settings and their defaults.
SETTINGS = {"body_window_months": 3, "retention": "window", "onboarding_completed_at": None, "backfill_cursor": None, "backfill_done": False}


def normalize_settings(given: dict | None) -> dict:
    """The known settings; a value that is not valid falls back to its default."""
    valid: dict[str, Callable[[object], bool]] = {
        "body_window_months": lambda v: isinstance(v, int) and not isinstance(v, bool) and 0 <= v <= 120,
        "retention": lambda v: v in ("window", "off"),
        "onboarding_completed_at": lambda v: isinstance(v, str),
        "backfill_cursor": lambda v: isinstance(v, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) is not None,
        "backfill_done": lambda v: v is True,
    }
    return {k: (given or {}).get(k) if valid[k]((given or {}).get(k)) else default for k, default in SETTINGS.items()}


BACKFILL_FLOOR = dt.datetime(2004, 1, 1, tzinfo=dt.UTC)


def next_backfill_slice(cursor: dt.datetime, months: int = 12) -> tuple[dt.datetime, dt.datetime] | None:
    """The slice before the cursor, newest first; None once the floor is reached."""
    if cursor <= BACKFILL_FLOOR:
        return None
    return max(BACKFILL_FLOOR, minus_months(cursor, months)), cursor


def next_backfill(settings: dict, now: dt.datetime) -> tuple[str, str] | None:
    """(since, until) as days of the slice that an account's settings call for next; None once its sweep is done."""
    if settings["backfill_done"]:
        return None
    until = settings["backfill_cursor"] or now.astimezone(dt.UTC).date().isoformat()
    found = next_backfill_slice(dt.datetime.fromisoformat(until).replace(tzinfo=dt.UTC))
    return found and (found[0].date().isoformat(), until)


def encode_cursor(sequence: int) -> str:
    return "crm_v1_" + base64.urlsafe_b64encode(str(sequence).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> int:
    if not (match := re.fullmatch(r"crm_v1_([A-Za-z0-9_-]+)", cursor)):
        raise ValueError("not a cursor")
    text = base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)).decode()
    if not text.isdigit():
        raise ValueError("not a cursor")
    return int(text)


def cursor_column(sequence: Column) -> Column:
    encoded = F.base64(sequence.cast("string").cast("binary"))
    return F.concat(F.lit("crm_v1_"), F.rtrim(F.translate(encoded, "+/=", "-_ ")))


def format_age(seconds: int | None) -> str:
    if seconds is None:
        return "never"
    for size, name in ((86_400, "d"), (3_600, "h"), (60, "m")):
        if seconds >= size:
            return f"{seconds // size}{name}"
    return f"{seconds}s"


def query_text(query: str | None = None, since: str | None = None, until: str | None = None, include_sent: bool = True) -> str:
    """A provider's search query: absolute days as after:/before:, relative ones as newer_than:."""
    parts = [query] if query else []
    if since:
        relative = re.fullmatch(r"(\d+)(d|m|y|w)", since)
        if relative:
            parts.append(f"newer_than:{int(relative[1]) * 7}d" if relative[2] == "w" else f"newer_than:{since}")
        else:
            parts.append(f"after:{calendar.timegm(dt.datetime.fromisoformat(since.replace('Z', '+00:00')).utctimetuple())}")
    if until:
        parts.append(f"before:{calendar.timegm(dt.datetime.fromisoformat(until.replace('Z', '+00:00')).utctimetuple())}")
    if not include_sent:
        parts.append("-in:sent")
    return " ".join(parts)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
