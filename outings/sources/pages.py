"""Landed web pages: structured event data, cards and articles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from outings.functions.rules import ARTICLE_DEFAULT_CATEGORY
from outings.functions.text import absolute_url, article_is_event
from outings.sources.rows import explode_computed

_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_EVENT = "Event"


def _field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def jsonld_objects(html: Column) -> Column:
    """Event objects of a page's structured data blocks; broken blocks are skipped."""
    blocks = F.transform(
        F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1)), lambda s: F.try_parse_json(s)
    )

    def is_event(v: Column) -> Column:
        return F.coalesce(_field(v, '$["@type"]') == _EVENT, F.lit(False))

    def objects(v: Column) -> Column:
        listed = F.filter(_field(v, "$", "array<variant>"), is_event)
        first = F.coalesce(_field(v, '$[0]["@type"]') == _EVENT, F.lit(False))
        none = F.array().cast("array<variant>")
        return F.when(is_event(v), F.array(v)).when(first, listed).otherwise(none)

    return F.flatten(F.transform(blocks, objects))


def _first_known(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def jsonld_fields(v: Column) -> list[Column]:
    """Flat columns of one event object."""
    address = _first_known(
        _field(v, "$.location.address.streetAddress"), _field(v, "$.location.address")
    )
    return [
        _field(v, "$.name").alias("name"),
        _field(v, "$.description").alias("description"),
        _field(v, "$.startDate").alias("start_text"),
        _field(v, "$.endDate").alias("end_text"),
        _field(v, '$["@id"]').alias("at_id"),
        _field(v, "$.identifier").alias("identifier"),
        _field(v, "$.url").alias("url"),
        _field(v, "$.location.name").alias("venue_name"),
        address.alias("venue_address"),
        _field(v, "$.location.geo.latitude", "double").alias("lat"),
        _field(v, "$.location.geo.longitude", "double").alias("lng"),
        _first_known(
            _field(v, "$.offers.price"), _field(v, "$.offers.priceSpecification.price")
        ).alias("price_text"),
        _first_known(_field(v, "$.image.url"), _field(v, "$.image")).alias("image_url"),
    ]


def jsonld_events(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per structured event: page columns, position, event fields."""
    kept = [c for c in pages.columns if c != html]
    return explode_computed(pages, kept, jsonld_objects(F.col(html)), "_v").select(
        *kept, "position", *jsonld_fields(F.col("_v"))
    )


# ---- cards ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class CardSpec:
    """Which elements are cards and where their fields are.

    A selector is a tag name or ``.class``. Text fields take the first matching
    element, ``attributes`` the attribute of the first, ``lists`` all texts.
    """

    cards: tuple[str, ...]
    texts: dict[str, tuple[str, ...]]
    attributes: dict[str, tuple[str, str]]
    lists: dict[str, tuple[str, ...]]
    # text field -> attribute that is preferred over the text
    preferred: dict[str, str]

    @property
    def ddl(self) -> str:
        fields = [f"{n}: STRING" for n in (*self.texts, *self.attributes)]
        fields += [f"{n}: ARRAY<STRING>" for n in self.lists]
        return f"STRUCT<{', '.join(fields)}>"


_LINKS = {"url": ("a", "href"), "image": ("img", "src")}

# The page layouts that are read.
EVENT_CARDS = CardSpec(
    cards=(".event-card", ".search-result"),
    texts={
        "title": ("h3", "h2", ".title"),
        "time": (".time", ".date-time"),
        "location": (".location", ".venue"),
        "description": (".description", ".summary"),
    },
    attributes=_LINKS,
    lists={"categories": (".category", ".tag")},
    preferred={},
)
SIMPLE_CARDS = CardSpec(
    cards=(".search-result", ".event-item", "article"),
    texts={
        "title": ("h2", "h3", ".title", ".event-title"),
        "date": (".date", ".event-date", "time"),
        "location": (".location", ".venue"),
        "description": (".description", ".summary", "p"),
    },
    attributes=_LINKS,
    lists={},
    preferred={},
)
ARTICLES = CardSpec(
    cards=("article", ".event-card", ".post-item"),
    texts={
        "title": ("h1", "h2", "h3", ".title", ".headline"),
        "published": (".date", ".publication-date", "time"),
        "author": (".author", ".contributor"),
        "category": (".category", ".tag"),
        "excerpt": (".excerpt", ".description", "p"),
    },
    attributes=_LINKS,
    lists={},
    preferred={"published": "datetime"},
)

_VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)


def _matches(selectors, tag: str, classes) -> bool:
    return any(s[1:] in classes if s[0] == "." else s == tag for s in selectors)


class _CardReader(HTMLParser):
    """Collects the cards of one page while its tags stream by."""

    def __init__(self, spec: CardSpec):
        super().__init__(convert_charrefs=True)
        self.spec, self.cards = spec, []
        self.stack = []  # (tag, cards opened here, text buffers opened here)

    def _open_cards(self):
        return [card for _, cards, _ in self.stack for card in cards]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        buffers = []
        for card in self._open_cards():
            for name, (wanted, attribute) in self.spec.attributes.items():
                if tag == wanted and name not in card:
                    card[name] = attrs.get(attribute)
            for name, selectors in self.spec.texts.items():
                if name not in card and _matches(selectors, tag, classes):
                    chosen = attrs.get(self.spec.preferred.get(name, ""))
                    card[name] = chosen if chosen else []
                    if not chosen:
                        buffers.append(card[name])
            for name, selectors in self.spec.lists.items():
                if _matches(selectors, tag, classes):
                    buffers.append([])
                    card.setdefault(name, []).append(buffers[-1])
        if tag in _VOID:
            return
        opened = []
        if _matches(self.spec.cards, tag, classes):
            opened.append({})
            self.cards.append(opened[0])
        self.stack.append((tag, opened, buffers))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        for _, _, buffers in self.stack:
            for buffer in buffers:
                buffer.append(data)


def page_cards(html: str | None, spec: CardSpec) -> list[dict]:
    reader = _CardReader(spec)
    reader.feed(html or "")
    reader.close()
    out = []
    for card in reader.cards:
        row = {n: None for n in (*spec.texts, *spec.attributes)}
        row |= {n: [] for n in spec.lists}
        for name, value in card.items():
            if name in spec.lists:
                row[name] = ["".join(b).strip() for b in value]
            else:
                row[name] = "".join(value).strip() if isinstance(value, list) else value
        out.append(row)
    return out


def with_cards(pages: DataFrame, spec: CardSpec, html: str = "html") -> DataFrame:
    """Pages with their ``cards`` that have a title, in page order."""
    from pyspark.sql import types as T

    kept = [f for f in pages.schema.fields if f.name != "cards"]
    cards = T.StructField("cards", T.ArrayType(T._parse_datatype_string(spec.ddl)))
    schema = T.StructType([*kept, cards])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cards"] = [
                [c for c in page_cards(h, spec) if c["title"]] for h in pdf[html]
            ]
            yield pdf

    return pages.mapInPandas(run, schema)


def html_cards(pages: DataFrame, spec: CardSpec = EVENT_CARDS, html: str = "html") -> DataFrame:
    """One row per card: page columns, position and the card's fields."""
    kept = [c for c in pages.columns if c != html]
    return (
        with_cards(pages, spec, html)
        .select(*kept, F.posexplode("cards").alias("position", "_c"))
        .select(*kept, "position", "_c.*")
    )


def simple_cards(pages: DataFrame, site_root: str, html: str = "html") -> DataFrame:
    """Cards of the plain layout with full links."""
    cards = html_cards(pages, SIMPLE_CARDS, html)
    return cards.withColumns(
        {c: absolute_url(F.col(c), site_root) for c in ("url", "image")}
    )


def event_articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Articles with a title and a link that are about events."""
    found = html_cards(pages, ARTICLES, html)
    complete = F.coalesce(F.col("title") != "", F.lit(False)) & F.coalesce(
        F.col("url") != "", F.lit(False)
    )
    return found.filter(complete & article_is_event(F.col("title"), F.col("category"))).withColumn(
        "category", F.coalesce(F.nullif(F.col("category"), F.lit("")),
                               F.lit(ARTICLE_DEFAULT_CATEGORY))
    )


def first_card(cards: Column, name: Column, prefix: int = 20) -> Column:
    """First card whose title holds the first ``prefix`` characters of ``name``, ignoring case."""
    start = F.substring(F.lower(name), 1, prefix)
    hits = F.filter(
        cards,
        lambda c: (F.coalesce(name, F.lit("")) != "") & F.lower(c["title"]).contains(start),
    )
    return F.try_element_at(hits, F.lit(1))


def jsonld_card_match(pages: DataFrame, html: str = "html") -> DataFrame:
    """Structured events, each with the first matching card of its page.

    Cards and events of a page sit in one row, so nothing is joined or shuffled.
    """
    kept = [c for c in pages.columns if c != html]
    both = explode_computed(
        with_cards(pages, EVENT_CARDS, html), [*kept, "cards"], jsonld_objects(F.col(html)), "_v"
    )
    flat = both.select(*kept, "cards", "position", *jsonld_fields(F.col("_v")))
    return flat.withColumn("card", first_card(F.col("cards"), F.col("name"))).drop("cards")
