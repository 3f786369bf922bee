"""The logo of a page: what it declares, its header, its body outside others' logo walls, its icons.

A page is read once inside its row; only pages whose answer hangs on the headings around an image
give rows of text, and those meet by page and container.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.common import let, once, text_array
from ..functions.html import attribute, tags, unescape, visible_markup
from ..functions.markup import VOID, fold_elements, page_parts, tag_name
from ..functions.urls import url_host, url_path
from ..session import cut_lineage

#: How deep objects may lie in a JSON-LD block, and how many containers of an image are looked at.
JSON_DEPTH, CONTAINERS = 8, 5
# Kinds of organisations, words of a logo, and what counts as a container's own text.
ORGANISATIONS = ("Organization", "Corporation", "LocalBusiness")
LOGO_WORDS = "logo|brand"
TEXT_ELEMENTS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "span", "div")


def is_foreign(url: Column, caption: Column | None = None) -> Column:
    """The URL, or the caption, names somebody else's logo."""
    by_url = F.exists(text_array(fixed.FOREIGN_LOGO_URLS), lambda p: F.contains(F.lower(url), p))
    return by_url if caption is None else by_url | F.exists(text_array(fixed.FOREIGN_LOGO_CAPTIONS), lambda p: F.contains(F.lower(caption), p))


def declared_logo(html: Column) -> Column:
    """The first organisation logo in a JSON-LD block, block by block; objects are read in the order they are written."""
    block = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"

    def fields(v: Column) -> Column:
        return F.when(v.startswith("{"), F.from_json(v, "map<string,string>"))

    def items(v: Column) -> Column:
        return F.coalesce(F.map_values(fields(v)), F.when(v.startswith("["), F.from_json(v, "array<string>")), F.array().cast("array<string>"))

    def inner(nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda n: F.transform(items(n["v"]), lambda v, i: F.struct(
            F.concat(n["path"], F.array(i)).alias("path"), F.trim(v).alias("v")))))

    def own_logo(v: Column) -> Column:
        def of(m: Column) -> Column:
            kind, logo = F.try_element_at(m, F.lit("@type")), F.trim(F.try_element_at(m, F.lit("logo")))
            kinds = F.coalesce(F.when(kind.startswith("["), F.from_json(kind, "array<string>")), F.array(kind))
            url = let(fields(logo), lambda x: F.coalesce(*(F.nullif(F.try_element_at(x, F.lit(k)), F.lit("")) for k in ("url", "contentUrl"))))
            plain = F.when(~logo.startswith("["), F.nullif(logo, F.lit("")))
            return F.when(F.arrays_overlap(kinds, text_array(ORGANISATIONS)), F.when(logo.startswith("{"), url).otherwise(plain))

        return let(fields(v), of)

    def first(text: Column) -> Column:
        empty = F.array().cast("array<int>")
        level = F.array(F.struct(empty.alias("path"), F.trim(text).alias("v")))

        def found(nodes: Column) -> Column:
            return F.transform(nodes, lambda n: F.struct(n["path"].alias("path"), own_logo(n["v"]).alias("logo")))

        def down(nodes: Column, depth: int) -> Column:
            nodes = F.filter(nodes, lambda n: n["v"].startswith("{") | n["v"].startswith("["))
            here = F.filter(found(nodes), lambda n: n["logo"].isNotNull())
            return here if depth == 0 else F.concat(here, let(inner(nodes), lambda more: down(more, depth - 1)))

        return F.when(F.try_parse_json(text).isNotNull(), F.array_min(let(level, lambda nodes: down(nodes, JSON_DEPTH)))["logo"])

    logos = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(block), 1), first)
    return F.get(F.filter(logos, lambda u: u.isNotNull() & ~is_foreign(u)), F.lit(0))


def head_images(html: Column) -> tuple[Column, Column]:
    """The page's icon (a touch icon before others), and the image for its previews."""
    links = tags(visible_markup(html), "link")

    def icon(word: str) -> Column:
        named = F.filter(links, lambda t: F.coalesce(F.contains(F.lower(attribute(t, "rel")), F.lit(word)), F.lit(False)))
        urls = F.transform(named, lambda t: F.coalesce(attribute(t, "href"), F.lit("")))
        return F.get(F.filter(urls, lambda u: (u != "") & ~is_foreign(u)), F.lit(0))

    previews = F.filter(tags(visible_markup(html), "meta"), lambda t: F.coalesce(attribute(t, "property") == "og:image", F.lit(False)))
    preview = F.coalesce(attribute(F.get(previews, F.lit(0)), "content"), F.lit(""))
    return F.coalesce(icon("apple-touch-icon"), icon("icon")), F.when((preview != "") & ~is_foreign(preview), preview)


def _site(host: Column) -> Column:
    return F.regexp_replace(host, "^[w.]+", "")


def _is_home(href: Column, url: Column) -> Column:
    same = (url_host(href) != "") & (_site(url_host(href)) == _site(url_host(url))) & (F.regexp_replace(url_path(href), "/+$", "") == "")
    return F.coalesce(href.isin("/", "#") | same, F.lit(False))


_ENTRY = "name:string,id:int,grid:boolean,home:boolean"
_TOLD = """struct<at:int,src:string,header:array<int>,body:boolean,near:array<int>,text:string,owners:array<struct<owner:int,child:int>>>"""


def page_images(html: Column, url: Column) -> Column:
    """Images with their containers, and texts with the containers whose own text they belong to, in order.

    ``header`` is where a header image comes in the order of headers, then navigations, and in
    each the first image of a link home before images named as logos. ``body`` tells an image named as
    a logo outside grids of logos, ``near`` the containers whose headings decide on it.
    """

    def read(tag: Column, at: Column) -> Column:
        is_tag, closes = tag.rlike("^</?[a-zA-Z]"), tag.startswith("</")
        name = F.when(is_tag, tag_name(tag)).otherwise("")
        opens = is_tag & ~closes

        def of(name: Column) -> Column:
            image = opens & (name == "img")
            words = F.lower(F.concat_ws(" ", attribute(tag, "class"), attribute(tag, "id")))
            return F.struct(
                name.alias("name"), closes.alias("closes"), (name.isin(*VOID) | tag.endswith("/>")).alias("void"), (at + 1).alias("at"),
                F.when(opens & F.contains(tag, F.lit("=")), F.exists(text_array(fixed.LOGO_GRID_CLASSES), lambda g: F.contains(words, g))).otherwise(False).alias("grid"),
                F.when(opens & (name == "a"), _is_home(attribute(tag, "href"), url)).otherwise(False).alias("home"),
                image.alias("image"), F.when(image, F.coalesce(attribute(tag, "src"), F.lit(""))).alias("src"),
                F.when(image, F.lower(F.concat_ws(" ", F.coalesce(attribute(tag, "alt"), F.lit("")), words))).alias("said"),
                F.when(image, F.coalesce(attribute(tag, "alt"), F.lit(""))).alias("alt"),
                F.when(~is_tag, F.nullif(F.trim(F.regexp_replace(F.replace(unescape(tag), F.lit("&nbsp;"), F.lit(" ")), r"[\s ]+", " ")), F.lit(""))).alias("text"))

        return let(name, of)

    def told(part: Column, around: Column) -> Column:
        usable = (part["src"] != "") & ~is_foreign(part["src"], part["alt"])
        named = part["said"].rlike(LOGO_WORDS)
        tops = F.filter(around, lambda x: x["name"].isin("header", "nav"))
        homes = F.filter(around, lambda x: (x["name"] == "a") & x["home"])
        rank = lambda c: F.when(c["name"] == "header", 0).otherwise(1)
        linked = F.flatten(F.transform(tops, lambda c: F.transform(
            F.filter(homes, lambda a: a["id"] > c["id"]), lambda a: F.array(rank(c), c["id"], F.lit(0), a["id"]))))
        plain = F.transform(F.filter(tops, lambda c: named), lambda c: F.array(rank(c), c["id"], F.lit(1), part["at"]))
        near = F.slice(F.reverse(F.concat(F.array(F.struct(F.lit(0).alias("id"), F.lit(False).alias("grid"))),
                                          F.transform(around, lambda x: F.struct(x["id"].alias("id"), x["grid"].alias("grid"))))), 1, CONTAINERS)
        ids = F.transform(around, lambda x: x["id"])
        owners = F.filter(F.transform(around, lambda x, i: F.when(x["name"].isin(*TEXT_ELEMENTS), F.struct(
            F.when(i == 0, 0).otherwise(F.get(ids, i - 1)).alias("owner"), x["id"].alias("child")))), lambda x: x.isNotNull())
        none, no_ids = F.array().cast("array<struct<owner:int,child:int>>"), F.array().cast("array<int>")
        image = let(near, lambda n: F.struct(
            part["at"].alias("at"), part["src"].alias("src"), F.array_min(F.concat(linked, plain)).alias("header"),
            (named & ~F.exists(n, lambda x: x["grid"])).alias("body"), F.transform(n, lambda x: x["id"]).alias("near"),
            F.lit(None).cast("string").alias("text"), none.alias("owners")))
        text = F.struct(part["at"].alias("at"), F.lit(None).cast("string").alias("src"), no_ids.alias("header"), F.lit(False).alias("body"),
                        no_ids.alias("near"), part["text"].alias("text"), owners.alias("owners"))
        return F.when(part["image"] & usable, image).when(part["text"].isNotNull(), text)

    def after(part: Column, open_now: Column) -> Column:
        # A link home stands for its first image only.
        spent = F.transform(open_now, lambda x: F.struct(
            x["name"].alias("name"), x["id"].alias("id"), x["grid"].alias("grid"), F.lit(False).alias("home"), x["times"].alias("times")))
        return F.when(part["image"] & F.exists(open_now, lambda x: x["home"]), spent).otherwise(open_now)

    return fold_elements(
        F.transform(page_parts(html), read), lambda part, around: F.struct(
            part["name"].alias("name"), part["at"].alias("id"), part["grid"].alias("grid"), part["home"].alias("home")), _ENTRY, told, _TOLD, after)


def page_logos(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page, source_url, extraction_location`` of each page that shows a logo of its own.

    In this order: the logo of an organisation it declares (``jsonld``), an image in a header or
    navigation that links home or is named as a logo (``header``), the first image named as a
    logo outside sections of partners, investors or clients (``body``), an icon (``favicon``), and
    the preview image (``og_image``). Names of others' logos are passed over. Page ids are unique.
    """
    given = pages.select(F.col(page).alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    icon, preview = head_images(F.col("html"))

    def gathered(told: Column) -> Column:
        # The smallest place; of equal ones (a link around a header in a header) the first image.
        heads = F.transform(F.filter(told, lambda x: F.coalesce(F.size(x["header"]) > 0, F.lit(False))),
                            lambda x: F.struct(x["header"].alias("place"), x["at"].alias("at"), x["src"].alias("src")))
        bodies = F.transform(F.filter(told, lambda x: x["body"]), lambda x: F.struct(x["at"].alias("at"), x["src"].alias("src"), x["near"].alias("near")))

        def of(bodies: Column) -> Column:
            wanted = F.array_distinct(F.flatten(F.transform(bodies, lambda x: x["near"])))
            squeezed = F.lower(F.regexp_replace(F.concat_ws("", F.transform(told, lambda x: x["text"])), " ", ""))
            hinted = F.exists(text_array([_hint(p) for p in fixed.FOREIGN_SECTION_HEADINGS]), lambda h: F.contains(squeezed, h))
            texts = F.when((F.size(bodies) > 0) & hinted, F.flatten(F.transform(
                F.filter(told, lambda x: x["text"].isNotNull()), lambda x: F.transform(
                    F.filter(x["owners"], lambda o: F.array_contains(wanted, o["owner"])),
                    lambda o: F.struct(o["owner"].alias("owner"), x["at"].alias("at"), o["child"].alias("child"), x["text"].alias("text"))))))
            return F.struct(
                F.array_min(heads)["src"].alias("header"), bodies.alias("bodies"),
                F.coalesce(texts, F.array().cast("array<struct<owner:int,at:int,child:int,text:string>>")).alias("texts"))

        return let(bodies, of)

    declared = given.select("page", "html", "url", once(F.struct(
        declared_logo(F.col("html")).alias("jsonld"), icon.alias("icon"), preview.alias("preview"))))
    # Pages are read once; what is kept of them is what the two uses below need.
    read = cut_lineage(declared.select("page", "jsonld", "icon", "preview", once(F.when(
        F.col("jsonld").isNull(), let(page_images(F.col("html"), F.col("url")), gathered)))))
    open_pages = read.where("jsonld IS NULL AND header IS NULL AND size(texts) > 0")
    parts = open_pages.select("page", F.inline("texts"))
    lines = parts.groupBy("page", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "child", "text"))).alias("lines"))
    # Texts of one child are joined as they stand, children with a blank between.
    joined = F.concat_ws("", F.transform("lines", lambda x, i: F.concat(
        F.when((i > 0) & (F.get(F.col("lines"), i - 1)["child"] == x["child"]), F.lit("")).otherwise(F.lit(" ")), x["text"])))
    heading = "(?i)" + "|".join(fixed.FOREIGN_SECTION_HEADINGS)
    foreign = lines.where(joined.rlike(heading)).groupBy("page").agg(F.collect_set("owner").alias("foreign"))
    decided = read.drop("texts").join(foreign, "page", "left")
    own = F.filter("bodies", lambda x: ~F.arrays_overlap(x["near"], F.coalesce(F.col("foreign"), F.array().cast("array<int>"))))
    sources = F.array(*(F.struct(c.alias("source_url"), F.lit(n).alias("extraction_location")) for c, n in (
        (F.col("jsonld"), "jsonld"), (F.col("header"), "header"), (F.array_min(own)["src"], "body"), (F.col("icon"), "favicon"), (F.col("preview"), "og_image"))))
    best = F.get(F.filter(sources, lambda s: s["source_url"].isNotNull()), F.lit(0))
    return decided.select(F.col("page").alias(page), F.inline(F.array_compact(F.array(best))))


def _hint(pattern: str) -> str:
    """Letters that every text with ``pattern`` has, its blanks left out."""
    return pattern.split(r"\s+(?:")[0].replace(r"\s+", "").replace(r"\s*s?\b", "").replace("s?", "")
