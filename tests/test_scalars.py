"""Scalar functions, distilling and image triage: golden cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import distill as D
from quillmesh.functions import images as I
from quillmesh.functions import scalars as S


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_addresses(spark):
    given = ["Ann <Ann@X.com>", "b@y.org", "nobody", None, "<c@z.net", '"Q, R" <q@r.s>', " <only@a.b>"]
    assert values(spark, S.extract_address, given) == ["ann@x.com", "b@y.org", None, None, "c@z.net", "q@r.s", "only@a.b"]
    assert values(spark, S.display_name, ["Ann <a@b>", '"Quo Ted" <a@b>', "<a@b>", "a@b", None]) == ["Ann", "Quo Ted", None, None, None]
    assert values(spark, S.split_recipients, ["a, b ,,c", None, ""]) == [["a", "b", "c"], [], []]
    assert values(spark, S.split_addresses, ["a@b, junk, c@d", None]) == [["a@b, junk", "c@d"], []]
    assert values(spark, S.host_of, ["Person@Example.COM", "no-at-sign", "trailing@"]) == ["example.com", None, None]


@pytest.mark.parametrize(
    ("host", "brand"),
    [("email.silversea.com", "silversea.com"), ("news.bbc.co.uk", "bbc.co.uk"), ("silversea.com.", "silversea.com"), ("mail.silversea.com:587", "silversea.com"), ("localhost", "localhost"), ("", None), ("a.b.com.au", "b.com.au"), ("X.Y.Z", "y.z")],
)
def test_registrable_domain(spark, host, brand):
    assert values(spark, S.registrable_domain, [host]) == [brand]


def test_classification(spark):
    labels = [["INBOX"], ["CATEGORY_SOCIAL", "CATEGORY_PERSONAL"], ["CATEGORY_FORUMS", "CATEGORY_UPDATES"], [], ["INBOX", "CATEGORY_PROMOTIONS"]]
    assert values(spark, S.classify_category, labels, "array<string>") == ["primary", "personal", "updates", None, "promotions"]
    headers = [{"LIST-ID": ""}, {"list-unsubscribe": None}, {"x": "y"}, {}]
    assert values(spark, S.classify_is_list, headers, "map<string,string>") == [True, False, False, False]


def test_text_shapes(spark):
    assert values(spark, lambda c: S.compact_snippet(c, 6), ["a  b\nc", "abcdefgh", " ", None]) == ["a b c", "abcde…", None, None]
    assert values(spark, S.parse_ref, ["a:b:c", ":b", "a:", "ab"])[0].asDict() == {"account": "a", "id": "b:c"}
    assert values(spark, S.parse_ref, [":b", "a:", "ab"]) == [None] * 3
    assert values(spark, S.safe_filename, ["a b/c.pdf", "a  b", "x" * 200, "", None]) == ["a_b_c.pdf", "a__b", "x" * 160, "attachment.bin", "attachment.bin"]


def test_numbers(spark):
    assert values(spark, lambda c: S.saturate(c, 3), [0, -1, 3], "int") == [0.0, 0.0, 0.5]
    assert values(spark, S.round2, [0.125, -0.125, 1.005], "double") == [0.13, -0.12, 1.0]
    pick = lambda c: S.suggest_action(c, F.lit(False))
    assert values(spark, pick, [3.0, -1.5, 0.0, None], "double") == ["important", "muted", "none", "none"]
    assert values(spark, lambda c: S.suggest_action(c, F.lit(True)), [0.0], "double") == ["muted"]


def test_driver_values():
    now = 1_700_000_000_000
    assert [S.parse_since(t, now) - now for t in ("1d", "2w", "12h", "1mo", "5m")] == [-86_400_000, -14 * 86_400_000, -43_200_000, -30 * 86_400_000, -300_000]
    with pytest.raises(ValueError):
        S.parse_since("soon", now)
    assert S.minus_months(dt.datetime(2026, 5, 31, tzinfo=dt.UTC), 3) == dt.datetime(2026, 3, 3, tzinfo=dt.UTC)
    assert S.window_cutoff(0, dt.datetime.now(dt.UTC)) is None
    assert S.normalize_settings({"body_window_months": 500, "x": 1, "retention": "on", "backfill_cursor": "May", "backfill_done": 1, "onboarding_completed_at": 5}) == S.normalize_settings(None) == S.SETTINGS
    own = {"body_window_months": 0, "retention": "off", "onboarding_completed_at": "2026-01-01T00:00:00Z", "backfill_cursor": "2010-03-31", "backfill_done": True}
    assert S.normalize_settings(own) == own and S.next_backfill(own, dt.datetime(2026, 1, 1, tzinfo=dt.UTC)) is None
    assert S.next_backfill(own | {"backfill_done": False}, dt.datetime(2026, 1, 1, tzinfo=dt.UTC)) == ("2009-03-31", "2010-03-31")
    assert S.next_backfill(S.SETTINGS, dt.datetime(2026, 5, 2, 9, tzinfo=dt.UTC)) == ("2025-05-02", "2026-05-02")
    assert S.next_backfill(own | {"backfill_done": False, "backfill_cursor": "2004-01-01"}, dt.datetime(2026, 1, 1, tzinfo=dt.UTC)) is None
    assert S.next_backfill_slice(dt.datetime(2004, 6, 1, tzinfo=dt.UTC))[0] == S.BACKFILL_FLOOR and S.next_backfill_slice(S.BACKFILL_FLOOR) is None
    assert S.decode_cursor(S.encode_cursor(1234)) == 1234 and S.format_age(7200) == "2h"
    assert S.parse_keywords("a, B,b ,,A") == ["a", "B"]
    assert "newer_than:14d" in S.query_text(since="2w") and S.query_text(include_sent=False) == "-in:sent"


def test_cursor_column(spark):
    assert values(spark, S.cursor_column, [7, 12345], "long") == [S.encode_cursor(7), S.encode_cursor(12345)]


def test_distill_html(spark):
    html = "<html><head><title>t</title></head><style>p{}</style><p>Hello&nbsp;&amp; w&eacute;l&#99;ome&zwnj;</p><div>Second<br>line</div><!-- c --><script>x()</script><p>Unsubscribe here</p><p>gone</p></html>"
    rows = spark.createDataFrame([(None, html), ("plain =E2=80=93 text\n> quoted\nmore", None), ("  ", "<p>x</p>"), (None, None)], "t string, h string")
    got = [r["x"] for r in rows.select(D.distill(F.col("t"), F.col("h")).alias("x")).collect()]
    assert got == ["Hello & w&eacute;lcome\n\nSecond\nline", "plain – text\nmore", "x", ""]


def test_deboilerplate(spark):
    texts = ["a\nOn Tue, Jordan wrote:\nb", "a\n--\nsig", "a\n-----Original Message-----\nb", "From: x\nb", "éunsubscribed\nb", "a\n© 2024 X\nb"]
    assert values(spark, D.deboilerplate, texts) == ["a", "a", "a", "", "éunsubscribed\nb", "a"]


def test_meaningful_length(spark):
    assert values(spark, D.meaningful_length, ["a b&zwnj;​c", None, " \n"]) == [3, 0, 0]


def test_images(spark):
    html = (
        '<img src="open.gif" width=1 height=1><img src="/spacer.gif" width="50" height="50"><img src="line.png" width="600" height="2.6"><img src="logo.png" width="300" height="100">'
        '<a href="http://x"><img src="hero.jpg" width="650" style="height: 300px" alt=" Hi "></a><img src="hero.jpg" width="650" height="300"><img src="photo.jpg"><img src="big.jpg" width="800" height="800"><img alt="x">'
    )
    rows = spark.createDataFrame([("m", html)], "m string, html string")
    found = I.classify_images(I.parse_images(rows))
    assert [(r["kind"], r["score"]) for r in found.orderBy("pos").collect()] == [("pixel", 0), ("spacer", 0), ("divider", 0), ("icon", 0), ("content", 595), ("content", 495), ("unknown", 0), ("content", 640)]
    assert [r["src"] for r in I.ocr_candidates(found, ["m"]).orderBy("rank").collect()] == ["big.jpg", "hero.jpg"]
