"""From raw pages to records.

Everything a regular expression can answer stays a JVM expression. Only what needs the element
tree (markdown of nested lists, pills inside a section, cards, selectors) goes through Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.entities import html5
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import vocab
from postloom.functions import markup, selectors
from postloom.functions.classify import months_to_level
from postloom.functions.predicates import clean_token
from postloom.functions.text import as_col, company_size, compose_location, let, strip
from postloom.operators.setops import distinct_ordered_items
from postloom.session import give_back

PAGES = 128  # results are packed for so many pages at a time

# How page texts show these characters; all other names are those of HTML 5.
SHOWN_AS = {"&nbsp;": " "}
NAMED_REFERENCES = {**{f"&{name}": shown for name, shown in html5.items() if name.endswith(";")}, **SHOWN_AS}


def unescape(c: Column | str) -> Column:
    """Decode character references in one pass (so `&amp;lt;` gives `&lt;`); unknown ones stay."""
    text = as_col(c)
    # one literal, which the optimizer turns into a constant map
    names = F.str_to_map(F.lit("\x01".join(f"{name}\x02{shown}" for name, shown in NAMED_REFERENCES.items())), F.lit("\x01"), F.lit("\x02"))
    # 128 to 159 mean windows-1252, as browsers read them
    low = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    controls = F.create_map(*[F.lit(x) for n, c in low.items() if c for x in (n, c)])

    def decode(token: Column) -> Column:
        hexa = F.regexp_extract(token, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        deci = F.regexp_extract(token, r"^&#([0-9]{1,7});$", 1)
        code = F.when(F.length(hexa) > 0, hexa).when(F.length(deci) > 0, F.conv(deci, 10, 16))
        value = F.conv(code, 16, 10).cast("long")
        odd = (value == 0) | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF)  # no character
        number = F.decode(F.unhex(F.lpad(F.when(odd, F.lit("FFFD")).otherwise(code), 8, "0")), "UTF-32")
        number = F.coalesce(F.try_element_at(controls, value.cast("int")), number)
        return F.coalesce(F.when(F.startswith(token, F.lit("&#")), number)
                          .when(F.startswith(token, F.lit("&")), F.try_element_at(names, token)), token)

    tokens = F.regexp_extract_all(text, F.lit(r"&#?\w{1,31};|[^&]+|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(tokens, decode), "")).otherwise(text)


def visible_text(html: Column | str) -> Column:
    """Text of a page: scripts, styles, comments and tags removed, references decoded."""
    bare = F.regexp_replace(as_col(html), r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    return unescape(F.regexp_replace(bare, r"<[^>]*>", ""))


def json_ld(html: Column | str, kind: str = "JobPosting") -> Column:
    """First JSON-LD item of the wanted `@type` as a variant; broken blocks are skipped, `@graph` is unwrapped."""
    blocks = F.regexp_extract_all(
        as_col(html), F.lit(r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?[^\"'>]*ld[^\"'>]*json[^>]*>(.*?)</script"), F.lit(1))

    def block_items(block: Column) -> Column:
        parsed = F.try_parse_json(unescape(strip(block)))
        return F.coalesce(F.try_variant_get(parsed, '$["@graph"]', "array<variant>"),
                          F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed))

    every = F.flatten(F.transform(blocks, block_items))
    return F.get(F.filter(every, lambda v: F.try_variant_get(v, '$["@type"]', "string") == kind), F.lit(0))


def first_element(html: Column | str, tag: str) -> Column:
    """Text of the first `<tag>`, or null."""
    inner = F.regexp_extract(as_col(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(strip(visible_text(inner)), F.lit(""))


def first_link_text(html: Column | str, href_part: str) -> Column:
    inner = F.regexp_extract(as_col(html), rf"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*{href_part}[^\"']*[\"'][^>]*>(.*?)</a\s*>", 1)
    return F.nullif(strip(visible_text(inner)), F.lit(""))


def canonical_url(html: Column | str) -> Column:
    tag = F.regexp_extract(as_col(html), r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"']?[^>]*>", 0)
    return F.nullif(F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def links(html: Column | str, href_part: str = "") -> Column:
    """All hrefs that contain `href_part`, in page order."""
    every = F.regexp_extract_all(as_col(html), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.filter(every, lambda h: F.contains(h, F.lit(href_part))) if href_part else every


def _per_page(kind: str, of: Callable, *columns: Column | str) -> Column:
    """`of` of each page (Arrow): one page is an object of Python at a time, results are packed every `PAGES` pages."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    packed = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:  # of one column: the column itself
            values = (of(*(v.as_py() for v in row)) for row in zip(*(batch if isinstance(batch, tuple) else (batch,))))
            parts = []
            while len(part := pa.array(list(islice(values, PAGES)), packed)):
                parts.append(part)
            yield pa.concat_arrays(parts) if parts else pa.array([], packed)
            del batch, values, parts, part
            give_back()

    return run(*[as_col(c) for c in columns])


def html_to_markdown(html: Column | str) -> Column:
    """Markdown of an HTML fragment (Arrow)."""
    return _per_page("string", markup.to_markdown, html)


def pill_texts(html: Column | str, *, heading: str = "Top Skills", heading_tag: str = "h2",
               containers: tuple[str, ...] = ("div", "section"), tags: tuple[str, ...] = ("div", "span", "a"),
               classes: str | None = vocab.PILL_CLASSES) -> Column:
    """Raw pill texts of a section (Arrow); `top_skills` applies the rules."""

    return _per_page("array<string>", lambda h: markup.pills_after(h, heading, heading_tag, containers, tags, classes), html)


def top_skills(pills: Column | str, n: int = 10) -> Column:
    """The first `n` distinct pills longer than 1 and shorter than 40 characters, without button labels."""
    kept = F.filter(as_col(pills), lambda t: clean_token(t, longer_than=1, shorter_than=40, deny=vocab.PILL_DENYLIST))
    return distinct_ordered_items(kept, n)


def posting_from_page(df: DataFrame, html: str = "html", *, source: str, markdown: bool = True) -> DataFrame:
    """One extracted posting per page: JSON-LD first, page elements where it is silent."""
    page = df.withColumn("_ld", json_ld(html))

    def ld(path: str) -> Column:
        return F.coalesce(F.try_variant_get("_ld", path, "string"), F.lit(""))

    def missing(c: str, fallback: Column) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), fallback, F.lit(""))

    # An object says its amount in `value`; one without an amount says nothing.
    shape = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("_ld", path, "variant")), F.lit(""))
    salary = F.when(~F.startswith(shape("$.baseSalary"), F.lit("OBJECT")), ld("$.baseSalary")).when(
        ~F.startswith(shape("$.baseSalary.value"), F.lit("OBJECT")), ld("$.baseSalary.value")).otherwise(ld("$.baseSalary.value.value"))
    months = F.try_variant_get("_ld", "$.experienceRequirements.monthsOfExperience", "double")
    fields = page.withColumns({
        "title": ld("$.title"), "company": ld("$.hiringOrganization.name"),
        "location": compose_location(ld("$.jobLocation.address.addressLocality"),
                                     ld("$.jobLocation.address.addressCountry")),
        "work_type": ld("$.employmentType"), "benefits": ld("$.jobBenefits"), "compensation": salary,
        "posted_date": ld("$.datePosted"), "level": months_to_level(months),
        "industries": F.coalesce(F.try_variant_get("_ld", "$.industry", "array<string>"), F.array().cast("array<string>")),
        "url": ld("$.url"), "_description": ld("$.description"),
    })
    fields = fields.withColumns({
        "title": missing("title", first_element(html, "h1")),
        "company": missing("company", first_link_text(html, "/company/")),
        "url": missing("url", canonical_url(html)),
        "company_size": company_size(visible_text(html)),
        "description": html_to_markdown("_description") if markdown else F.col("_description"),
        "skills": top_skills(pill_texts(html)) if markdown else F.array().cast("array<string>"),
        "source": F.lit(source),
    })
    fields = fields.withColumn("job_id", F.when(F.col("url") == "", "").otherwise(
        F.substring_index(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "/", -1)))
    return fields.drop("_ld", "_description")


CARD_ROW = "card_no int, title string, link string, company string, location string, work_type string, compensation string, level string"


def cards(df: DataFrame, html: str = "html", keep: list[str] = (), *, url: str | None = None) -> DataFrame:
    """One row per listing card with a title and a company (Arrow): the cards of both forms, from one parse of the page.

    `url` names the column with the page's address, against which links are resolved. Null and empty pages have no cards."""

    place = F.col(url) if url else F.lit(None).cast("string")
    kind = f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in CARD_ROW.split(', '))}>>"
    return df.select(*keep, _per_page(kind, selectors.cards_of, html, place).alias("_cards")).select(*keep, F.inline("_cards"))


def elements(html: Column | str, wanted: dict[str, str], attribute: str | None = None) -> Column:
    """struct of the named selectors: per page the texts (white space as one blank) of all elements that fit, in page order, or the values of
    an attribute of theirs (Arrow). One parse answers all of them."""

    for text in wanted.values():
        selectors.selector(text)  # errors are the caller's, not a task's

    def find(page: str | None) -> dict[str, list]:
        with markup.tree(page or "") as root:
            return {name: [selectors.squeezed(n) if attribute is None else n.attrs.get(attribute) for n in selectors.select(root, text)]
                    for name, text in wanted.items()}

    return _per_page("struct<" + ", ".join(f"`{name}`: array<string>" for name in wanted) + ">", find, html)


def card_text(c: Column | str) -> Column:
    """struct(company, location) guessed from the lines of a card.

    The last line with a dash gives both; a line naming a known place is the location if it comes
    at or after that line.
    """
    def last(lines: Column, pattern: str) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        return F.try_element_at(F.filter(numbered, lambda m: m.getField("x").rlike(pattern)), F.lit(-1))

    def guess(dash: Column, place: Column) -> Column:
        parts = F.split(dash.getField("x"), "—|-")
        by_place = place.isNotNull() & (dash.isNull() | (place.getField("i") >= dash.getField("i")))
        piece = lambda n: F.coalesce(strip(F.get(parts, F.lit(n))), F.lit(""))
        return F.struct(piece(0).alias("company"), F.when(by_place, place.getField("x")).otherwise(piece(1)).alias("location"))

    lines = F.filter(F.transform(F.split(as_col(c), "\n"), strip), lambda x: F.length(x) > 0)
    places = "(?i)" + "|".join(vocab.LOCATION_WORDS)
    return let([lines], lambda x: let([last(x, "—|-"), last(x, places)], guess))
