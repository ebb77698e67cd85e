"""Edge rows of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from outings.functions import hours as H
from outings.functions import rules as R
from outings.functions import scoring as S
from outings.functions import text as X
from outings.functions import times as T
from outings.functions import vectors as V
from outings.schemas import HOURS_DDL

L = F.lit


def hours(json: str | None):
    return F.from_json(L(json).cast("string"), HOURS_DDL)


def period(day, opens, closes=None, close_day=None):
    close = f', "close": {{"day": {day if close_day is None else close_day}, "time": "{closes}"}}'
    return f'{{"open": {{"day": {day}, "time": "{opens}"}}{close if closes else ""}}}'


def doc(*periods):
    return ('{"type": "standard", "always_open": false, "periods": [' + ",".join(periods) + "]}")


MONDAY = "2024-01-15"


@pytest.mark.parametrize(
    "h, at, strict, expected",
    [
        (None, f"{MONDAY} 03:00:00", False, True),
        (('{"general": "daily"}'), f"{MONDAY} 03:00:00", False, True),
        (doc(), f"{MONDAY} 03:00:00", False, True),
        (('{"type": "always_open"}'), f"{MONDAY} 03:00:00", False, True),
        (doc(period(1, "0900", "1700")), f"{MONDAY} 09:00:00", False, True),
        (doc(period(1, "0900", "1700")), f"{MONDAY} 17:00:00", False, False),
        (doc(period(2, "0900", "1700")), f"{MONDAY} 10:00:00", False, False),
        (doc(period(1, "0900")), f"{MONDAY} 23:59:00", False, True),
        # overnight: today's late period also opens the early morning before it
        (doc(period(1, "1800", "0200", 2)), f"{MONDAY} 01:00:00", False, True),
        (doc(period(1, "1800", "0200", 2)), f"{MONDAY} 01:00:00", True, False),
        (doc(period(0, "1800", "0200", 1)), f"{MONDAY} 01:00:00", False, False),
        (doc(period(0, "1800", "0200", 1)), f"{MONDAY} 01:00:00", True, True),
        (doc(period(1, "1800", "0200", 2)), f"{MONDAY} 12:00:00", False, False),
        # the hour and minute form
        (('{"periods": [{"open": {"day": 1, "hour": 9, "minute": 30}, '
               '"close": {"day": 1, "hour": 10, "minute": 15}}]}'),
         f"{MONDAY} 10:14:00", False, True),
        (('{"periods": [{"open": {"day": 1, "hour": 9, "minute": 30}, '
               '"close": {"day": 1, "hour": 10, "minute": 15}}]}'),
         f"{MONDAY} 10:15:00", False, False),
    ],
)
def test_is_open(value, h, at, strict, expected):
    assert value(H.is_open(hours(h), T.ts(at), strict)) is expected


def test_hours_texts(value):
    week = ('{"always_open": false, "weekday_text": ["Monday: 9 - 5", "Tuesday: 9 - 5", '
            '"Wednesday: Closed"], "periods": []}')
    same = '{"always_open": false, "weekday_text": ["Monday: 9 - 5", "Tuesday: 9 - 5"]}'
    at = T.ts("2024-01-17 12:00:00")
    assert value(H.todays_hours(hours(week), at)) == "Closed"
    assert value(H.todays_hours(hours(same), at)) == "Hours not available"
    assert value(H.hours_summary(hours(week))) == "9 - 5 (varies)"
    assert value(H.hours_summary(hours(same))) == "9 - 5"
    assert value(H.hours_summary(L(None).cast(HOURS_DDL))) == "Hours not available"
    assert value(H.hours_summary(hours("{}"))) == H.SEE_MAPS
    assert value(H.hours_status(hours("{}"), at)) == "Hours not available"
    assert value(H.hours_status(hours(same), at)) == "Open now"
    assert value(H.has_seasonal_hours(hours('{"weekday_text": ["Closed for SEASON"]}'))) is True
    assert value(H.has_seasonal_hours(hours("{}"))) is False


def test_closes_early_needs_a_majority(value):
    half = doc(period(1, "0900", "1700"), period(2, "0900", "2000"))
    most = doc(period(1, "0900", "1700"), period(2, "0900", "1700"), period(3, "0900", "2000"))
    assert value(H.closes_early(hours(half))) is False
    assert value(H.closes_early(hours(most))) is True
    assert value(H.closes_early(hours(doc(period(1, "0900"))))) is False


@pytest.mark.parametrize(
    "text, expected",
    [
        ("20240115T193000Z", dt.datetime(2024, 1, 15, 19, 30)),
        ("20240115", dt.datetime(2024, 1, 15)),
        ("2024011519", dt.datetime(2024, 1, 15, 19)),
        ("20240115T1930;X=1", dt.datetime(2024, 1, 15, 19, 30)),
        ("2024", None),
        ("20241399T000000", None),
        ("", None),
    ],
)
def test_parse_ics_date(value, text, expected):
    assert value(T.parse_ics_date(L(text))) == expected


def test_parse_event_date(value):
    published = T.ts("2024-01-03 08:00:00")
    get = lambda s: value(T.parse_event_date(L(s), published))
    assert get("January 15, 2026") == dt.datetime(2026, 1, 15)
    assert get("on Jan 5 2026") == dt.datetime(2026, 1, 5)
    assert get("1/15/2026") == dt.datetime(2026, 1, 15)
    assert get("February 9") == dt.datetime(2024, 2, 9)
    assert get("7:30 pm") == dt.datetime(2024, 1, 3, 8)
    assert get("") is None


def test_clamp_request_date(value):
    now = T.ts("2024-01-15 00:00:00")
    assert value(T.clamp_request_date(T.ts("2024-01-14 23:00:00"), now)) is None
    assert value(T.clamp_request_date(T.ts("2024-03-01 00:00:00"), now)) == dt.datetime(2024, 1, 29)


def test_slugs(value):
    assert value(X.slugify_words(L("Café  Noir -- it's 5!"))) == "caf-noir-its-5"
    assert value(X.slugify_alnum(L("  Café Noir! "))) == "caf-noir"
    once = X.slugify_words(L("A  B--C"))
    assert value(X.slugify_words(once)) == value(once)


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, (True, None, None, "Free")),
        ("", (True, None, None, "Free")),
        ("FREE for all", (True, None, None, "FREE for all")),
        ("$12.50 - $20", (False, 12.5, 20.0, "$12.50 - $20")),
        ("ask", (False, None, None, "ask")),
    ],
)
def test_parse_price(value, text, expected):
    assert tuple(value(X.parse_price(L(text).cast("string")))) == expected


def test_loose_parsing(value):
    assert value(X.parse_int_or(L("3 stars"), 2)) == 3
    assert value(X.parse_int_or(L("0"), 2)) == 2
    assert value(X.parse_int_or(L("NaN"), 1)) == 1
    triple = value(X.parse_vibe_triple(L("0.4 (calm), 0.8 (in), 0.3")))
    assert tuple(triple) == (0.4, 0.8, 0.3)
    assert tuple(value(X.parse_vibe_triple(L("calm")))) == (0.5, 0.5, 0.5)
    assert value(X.split_tags(L("a , b,c "))) == ["a", "b", "c"]


def test_json_repair(value):
    assert value(X.fix_json(L('{a: b-c, "d":"e, f", g:[h,1], at:09:30, ok:true}'))) == (
        '{"a": "b-c", "d":"e, f", "g":["h",1], "at":"09:30", "ok":true}'
    )
    raw = "{open:08:00, kind:regular,hours_verified:false}"
    assert value(X.hours_unverified(L(raw))) is True
    assert value(X.hours_unverified(L(raw.replace("false", "true")))) is False
    assert value(X.hours_unverified(L("by appointment"))) is False


def test_json_repair_leaves_quoted_text_and_null(value):
    raw = r'{"note": "bar, grill, pub", said:"a \"b, c\" d", none: null, true: true, nullish: null-ish, hours_verified: false}'
    assert value(X.fix_json(L(raw))) == (
        r'{"note": "bar, grill, pub", "said":"a \"b, c\" d", "none": null, "true": true, "nullish": "null-ish", '
        '"hours_verified": false}'
    )
    assert value(X.hours_unverified(L(raw))) is True
    assert value(X.fix_json(L(None).cast("string"))) is None and value(X.fix_json(L(""))) == ""
    assert value(X.fix_json(L('{"open, a: b'))) == '{"open, a: b'  # an open quote reaches to the end
    for long in ("x, y: " * 20_000, '\\"' * 20_000):
        assert value(X.fix_json(L('{a: "' + long + '", b: c}'))) == '{"a": "' + long + '", "b": "c"}'


def test_json_repair_of_deep_indents(value):
    deep = "\n" + " " * 40
    raw = "{" + deep + "open: 08:00," + deep + "kinds: [" + deep + "a," + deep + "b]," + deep + "hours_verified:" + deep + "false}"
    fixed = "{" + deep + '"open": "08:00",' + deep + '"kinds": [' + deep + '"a",' + deep + '"b"],' + deep + '"hours_verified":' + deep + "false}"
    assert value(X.fix_json(L(raw))) == fixed
    assert value(X.hours_unverified(L(raw))) is True


def test_venues_and_times(value):
    assert value(X.extract_location(L("Meet at Union Hall on Friday"))) == "Union Hall"
    assert value(X.extract_location(L("Venue: The Shed. Late"))) == "The Shed"
    assert value(X.extract_location(L("nowhere"))) is None
    assert value(T.extract_time(L("from 7pm, show 8:30 PM"))) == "8:30 PM"
    assert value(T.extract_time(L("from 7 pm"))) == "7 pm"


def test_tag_rules(value):
    # no word boundary by default: "party" holds "art"
    assert value(R.infer_categories(L("Party"), L(None).cast("string"))) == ["art", "culture"]
    bounded = R.infer_categories(L("Party"), L(""), word_boundary=True)
    assert value(bounded) == ["general"]
    both = R.infer_categories(L("music"), L("dance"))
    assert value(both) == ["music", "live-music", "music", "social", "nightlife"]
    once = R.infer_categories(L("music"), L("dance"), dedupe=True)
    assert value(once) == ["music", "live-music", "social", "nightlife"]
    assert value(R.infer_user_tags(L("x"), L("y"))) == []
    tags = F.array(L("b"), L("a"))
    assert value(R.union_tags(tags, F.array(L("a"), L("c")))) == ["b", "a", "c"]
    assert value(R.matching_tags(F.array(L("a"), L("x"), L("a")), tags)) == ["a", "a"]
    assert value(R.user_tags_only(F.array(L("nature"), L("free"), L("free")))) == ["free", "free"]


def test_vibes(value):
    sports = value(R.infer_vibe_3d(R.string_array(["sports"])))
    assert tuple(sports) == (0.2, 0.2, 0.6)
    assert tuple(value(R.infer_vibe_3d(R.string_array(["music"])))) == (0.2, 0.5, 0.7)
    assert tuple(value(R.infer_vibe_3d(R.string_array(["art"])))) == (0.7, 0.9, 0.3)
    assert value(R.event_vibe_active(R.string_array(["music", "dance"]), L(False))) == 0.6
    all_four = R.string_array(["music", "dance", "sports", "active", "x"])
    assert value(R.event_vibe_active(all_four, L(False))) == 0.8


def test_score_parts(value):
    assert value(S.round1(L(-0.25))) == -0.2
    assert value(S.round1(L(0.25))) == 0.3
    assert value(S.vibe_match(L(None).cast("double"), L(0.25))) == 0.75
    assert value(S.vibe_match(L(0.0), L(0.25))) == 0.75
    assert value(S.needed_minutes(L(0))) is None
    assert value(S.availability_bonus(L(30), L(90))) == 0.0
    assert value(S.availability_bonus(L(15), L(120))) == 5.0
    assert value(S.tag_score(R.string_array([]), R.string_array(["a"]))) == 0.0
    assert value(S.tag_score(R.string_array(["a"]), L(None).cast("array<string>"))) == 0.0
    assert value(S.low_energy_penalty(L(True), L(None).cast("boolean"))) == -15.0


def test_texts(value):
    null = L(None).cast("double")
    body = V.activity_text(L("T"), L(""), R.string_array(["music", "free"]), null, null, null)
    assert value(body) == (
        "T. Tags: free. lively atmosphere, outdoor space, relaxing activity"
    )
    assert value(V.activity_text(L("T"), L("D"), R.string_array([]))) == "T. D"
    wish = V.preference_text(L(0.5), L(0.8), L("either"), R.string_array(["a", "b"]))
    assert value(wish) == (
        "moderate atmosphere. relaxing, low-energy activity. Looking for: a, b"
    )
    long = (L("n"), L("x" * 9000), L(""), R.string_array([]))
    assert value(F.length(V.place_text(*long))) == 9003
    assert value(F.length(V.place_text(*long, limit=8000))) == 8000


def test_vectors(value):
    a, b = V.vector_literal([1, 0]), V.vector_literal([1, 1])
    assert value(V.cosine_similarity(a, b)) == pytest.approx(0.5**0.5)
    assert value(V.cosine_similarity(a, V.vector_literal([0, 0]))) is None


def test_seasons(value):
    def get(**k):
        base = dict(name="n", category="café", story=None, nudge=None, tags=[], current=None)
        base |= k
        return value(
            R.tagged_seasons(
                *[L(base[c]).cast("string") for c in ("name", "category", "story", "nudge")],
                R.string_array(base["tags"]),
                L(None).cast("array<string>") if base["current"] is None
                else R.string_array(base["current"]),
                "%pond meadow%",
            )
        )

    assert get(name="Old Pond Meadow Park") == ["summer", "fall"]
    assert get(name="Pope Farm Beach", category="beach") == ["summer"]
    assert get(story="first snow", current=["spring"]) == ["spring"]
    assert get(story="Late summer, all year round") is None
    assert get(tags=["skiing"]) == ["winter"]
