"""Web pages: one HTML pass per page into columns, then scores, site checks and roll-ups as table jobs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewright.functions.storage import PIECE, by_shuffle, landed, small_batches

SKIPPED, VOID = {"script", "style", "nav", "footer", "header"}, {"meta", "link", "img", "br", "hr", "input", "source", "area", "base", "col", "embed", "track", "wbr"}
SCHEMA = """page_id long, url string, title string, description string, viewport string, canonical string, robots string, lang string, favicon string,
 hreflang array<struct<lang: string, href: string>>, og map<string, string>, twitter map<string, string>, headings array<struct<level: int, text: string>>,
 images struct<total: int, with_alt: int, with_size: int, lazy: int>, links array<struct<href: string, text: string, internal: boolean>>, words int, text string, schema_types array<string>, keywords string,
 structure struct<tables: int, lists: int, definitions: int, boxes: int, lead_words: int>"""
#: Tags that count as tables, lists, definitions and boxes.
COUNTED = {"table": "tables", "ul": "lists", "ol": "lists", "dl": "definitions", "dfn": "definitions", "aside": "boxes", "blockquote": "boxes"}


class _Page(HTMLParser):
    """Collects what the audit needs; tags that are never closed do no harm."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.host = url, urlsplit(url).netloc
        self.meta: dict[str, str] = {}
        self.rel: dict[str, str] = {}
        self.hreflang, self.headings, self.links, self.ld = [], [], [], []
        self.images = {"total": 0, "with_alt": 0, "with_size": 0, "lazy": 0}
        self.structure = {"tables": 0, "lists": 0, "definitions": 0, "boxes": 0, "lead_words": 0}
        self.title = self.lang = None
        self.open: list[str] = []
        self.text: list[str] = []
        self.held: list[list] = []  # open title, heading, a, JSON-LD: [tag, pieces, extra]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang") or None
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name and "content" in a:
                self.meta.setdefault(name, a["content"])
        elif tag == "link":
            for r in a.get("rel", "").lower().split():
                self.rel.setdefault(r, a.get("href", ""))
            if a.get("hreflang"):
                self.hreflang.append({"lang": a["hreflang"], "href": a.get("href", "")})
        elif tag == "img":
            self.images["total"] += 1
            self.images["with_alt"] += bool(a.get("alt", "").strip())
            self.images["with_size"] += "width" in a and "height" in a
            self.images["lazy"] += a.get("loading") == "lazy"
        if tag in COUNTED and not self.open:
            self.structure[COUNTED[tag]] += 1
        if tag in ("title", "a", "p") or re.fullmatch("h[1-6]", tag) or (tag == "script" and a.get("type") == "application/ld+json"):
            self.held.append([tag, [], a.get("href")])
        if tag in SKIPPED:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED and tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        at = next((i for i in range(len(self.held) - 1, -1, -1) if self.held[i][0] == tag), None)
        if at is None:
            return
        _, pieces, href = self.held.pop(at)
        text = " ".join("".join(pieces).split())
        if tag == "title":
            self.title = self.title or text
        elif tag == "script":
            self.ld.append("".join(pieces))
        elif tag == "a":
            self._link(href, text)
        elif tag == "p":  # the first paragraph with words
            self.structure["lead_words"] = self.structure["lead_words"] or len(text.split())
        else:
            self.headings.append({"level": int(tag[1]), "text": text})

    def _link(self, href, text):
        href = (href or "").strip()
        if href and not href.startswith(("#", "mailto:", "tel:", "javascript:")):
            try:
                full = urljoin(self.url, href)
                self.links.append({"href": full, "text": text, "internal": urlsplit(full).netloc == self.host})
            except ValueError:
                pass

    def handle_data(self, data):
        for h in self.held:
            h[1].append(data)
        if not self.open and not any(h[0] == "title" for h in self.held):
            self.text.append(data)

    def schema_types(self) -> list[str]:
        found: set[str] = set()

        def walk(x):
            if isinstance(x, dict):
                t = x.get("@type")
                found.update([t] if isinstance(t, str) else [y for y in t or [] if isinstance(y, str)])
                for y in x.values():
                    walk(y)
            elif isinstance(x, list):
                for y in x:
                    walk(y)

        for block in self.ld:
            try:
                walk(json.loads(block))
            except (ValueError, RecursionError):
                continue
        return sorted(found)


def audit_html(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> one row of SCHEMA each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at : at + PIECE] for b in batches for at in range(0, len(b), PIECE)):
            rows = []
            for r in pdf.itertuples():
                p = _Page(r.url or "")
                p.feed(r.html or "")
                p.close()
                text = " ".join(" ".join(p.text).split())
                group = lambda prefix, p=p: {k: v for k, v in p.meta.items() if k.startswith(prefix)}
                rows.append((r.page_id, r.url, p.title, p.meta.get("description"), p.meta.get("viewport"), p.rel.get("canonical"), p.meta.get("robots"), p.lang, p.rel.get("icon"), p.hreflang, group("og:"), group("twitter:"), p.headings, p.images, p.links, len(text.split()), text, p.schema_types(), p.meta.get("keywords"), p.structure))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in "page_id url title description viewport canonical robots lang favicon hreflang og twitter headings images links words text schema_types keywords structure".split()])

    return small_batches(pages).select("page_id", "url", "html").mapInPandas(run, SCHEMA)


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1))


def page_meta(audit: DataFrame) -> DataFrame:
    return audit.select("page_id", "title", F.length("title").alias("title_length"), "description", "viewport", "canonical", "robots", "lang", "favicon", "hreflang", "og", "twitter")


def page_headings(audit: DataFrame) -> DataFrame:
    of = lambda k: F.transform(F.filter("headings", lambda h: h["level"] == k), lambda h: h["text"])
    return audit.select("page_id", *[of(k).alias(f"h{k}") for k in range(1, 7)])


def page_images(audit: DataFrame) -> DataFrame:
    return audit.select("page_id", "images.*", F.when(F.col("images.total") > 0, F.col("images.with_alt") * 100.0 / F.col("images.total")).otherwise(100.0).alias("alt_ratio"))


def _links() -> dict[str, Column]:
    inside, out = F.filter("links", lambda x: x["internal"]), F.filter("links", lambda x: ~x["internal"])
    unique = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["href"])))
    return {"internal": F.size(inside), "internal_unique": unique(inside), "external": F.size(out), "external_unique": unique(out)}


def page_links(audit: DataFrame) -> DataFrame:
    return audit.select("page_id", *[c.alias(k) for k, c in _links().items()])


#: Signs of questions and answers, of a summary, of a date.
FAQ = ["faq", "вопрос", "ответ", "часто задаваемые", "frequently asked"]
SUMMARY = ["tl;dr", "tldr", "key takeaway", "краткое содержание", "резюме", "ключевые выводы", "в двух словах"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
UPDATED = ["обновлено", "updated", "дата обновления"]
DATE = "(?iu)" + "|".join([rf"\d{{1,2}}\s+({'|'.join(MONTHS)})\s+\d{{4}}", r"\d{4}-\d{2}-\d{2}", rf"({'|'.join(MONTH_NAMES)})\s+\d{{1,2}},?\s+\d{{4}}", *UPDATED])


def _content() -> dict[str, Column]:
    low = F.lower("text")
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return {"has_faq": has(FAQ), "has_summary": has(SUMMARY), "has_date": F.col("text").rlike(DATE)}


def page_content(audit: DataFrame) -> DataFrame:
    return audit.select("page_id", "words", *[c.alias(k) for k, c in _content().items()])


def page_schema_types(audit: DataFrame) -> DataFrame:
    return audit.select("page_id", F.explode("schema_types").alias("type"))


#: What links to pages of trust say, hosts of social networks and of authorities, signs of an author.
ABOUT, CONTACT, PRIVACY = ["about", "о нас", "о компании", "об авторе"], ["contact", "контакт", "связаться", "обратная связь"], ["privacy", "конфиденциальност", "политика"]
SOCIAL = [r"linkedin\.com", r"facebook\.com", r"twitter\.com", r"x\.com", r"instagram\.com", r"youtube\.com", r"t\.me", r"vk\.com"]
AUTHORITIES = [r"wikipedia\.org", r"doi\.org", r"\.gov", r"\.edu", r"scholar\.google", r"researchgate\.net", r"statista\.com", r"mckinsey\.com", r"hbr\.org", r"forbes\.com"]
AUTHOR = [r"автор[:\s]", r"author[:\s]", "written by", r"by\s+[a-z]"]


def _eeat() -> dict[str, Column]:
    says = lambda words: F.exists("links", lambda x: F.lower(F.concat_ws(" ", x["href"], x["text"])).rlike("|".join(words)))
    return {
        "about_page": says(ABOUT),
        "contact_page": says(CONTACT),
        "privacy_policy": says(PRIVACY),
        "social_links": F.exists("links", lambda x: F.lower(x["href"]).rlike("|".join(SOCIAL))),
        "author_page": F.lower("text").rlike("|".join(AUTHOR)),
        "external_citations": F.size(F.filter("links", lambda x: x["href"].rlike("|".join(AUTHORITIES)))),
    }


def page_eeat(audit: DataFrame) -> DataFrame:
    return audit.select("page_id", *[c.alias(k) for k, c in _eeat().items()])


POINTS = {"critical": 15, "high": 10, "medium": 5, "low": 2}


def page_score(audit: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(page_id, url, score, issues): 100 less 15, 10, 5 or 2 for each issue, not below 0.

    context may give per page: search_blocked, ai_blocked, sitemap, redirects; without it they raise no issue.
    """
    d = audit.withColumns(_content() | _eeat() | _links())
    names = ["search_blocked", "ai_blocked", "sitemap", "redirects"]
    d = d.join(context.select("page_id", *names), "page_id", "left") if context is not None else d.withColumns({n: F.lit(None) for n in names})
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    h1 = F.size(F.filter("headings", lambda h: h["level"] == 1))
    long_title = F.length("title") > 60
    rules = [
        ("critical", "no_https", ~F.lower("url").startswith("https://")), ("critical", "search_bots_blocked", F.col("search_blocked")), ("critical", "no_title", blank("title")), ("critical", "no_h1", h1 == 0), ("high", "several_h1", h1 > 1),
        ("high", "no_description", blank("description")), ("medium", "long_description", F.length("description") > 160), ("medium", "long_title", long_title), ("high", "no_viewport", blank("viewport")), ("high", "no_canonical", blank("canonical")),
        ("high", "no_schema", F.size("schema_types") == 0), ("high", "no_sitemap", ~F.col("sitemap")), ("high", "ai_bots_blocked", F.col("ai_blocked")), ("medium", "no_open_graph", F.size("og") == 0), ("low", "no_twitter_card", F.size("twitter") == 0),
        ("medium", "no_lang", blank("lang")), ("low", "no_favicon", blank("favicon")), ("medium", "few_alts", (F.col("images.total") > 0) & (F.col("images.with_alt") * 100 < F.col("images.total") * 80)), ("medium", "thin_content", F.col("words") < 300),
        ("low", "no_summary", ~F.col("has_summary") & (F.col("words") > 1000)), ("medium", "no_date", ~F.col("has_date")), ("medium", "no_about", ~F.col("about_page")), ("medium", "no_author", ~F.col("author_page")), ("low", "no_privacy", ~F.col("privacy_policy")),
        ("medium", "few_internal_links", F.col("internal_unique") < 3), ("medium", "redirect_chain", F.col("redirects") > 1),
    ]
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c.cast("boolean"), F.lit(False)), F.struct(F.lit(p).alias("priority"), F.lit(r).alias("rule_id"), F.lit(POINTS[p]).alias("points"))) for p, r, c in rules]))
    d = d.select("page_id", "url", issues.alias("issues"))
    return d.select("page_id", "url", F.greatest(F.lit(0), 100 - F.aggregate("issues", F.lit(0), lambda s, i: s + i["points"])).alias("score"), "issues")


def score_band(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 80, "good").when(s >= 60, "fair").when(s >= 40, "weak").otherwise("critical")


def issue_summary(scores: DataFrame) -> DataFrame:
    """(priority, rule_id, pages) over all pages."""
    return scores.select("page_id", F.explode("issues").alias("i")).groupBy("i.priority", "i.rule_id").agg(F.count_distinct("page_id").alias("pages"))


def site_duplicates(pages: DataFrame, column: str) -> DataFrame:
    """(host, value, pages) of values that several pages of a host share; pages has url and the column."""
    return pages.where(F.trim(column) != "").groupBy(host("url").alias("host"), F.col(column).alias("value")).agg(F.count("*").alias("pages")).where("pages > 1")


def link_integrity(audit: DataFrame) -> DataFrame:
    """(page_id, href): internal links to no page of the table."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "/+$", "")
    links = audit.select("page_id", F.explode("links").alias("l")).where("l.internal").select("page_id", F.col("l.href").alias("href"), clean("l.href").alias("_k")).distinct()
    return links.join(audit.select(clean("url").alias("_k")).distinct(), "_k", "left_anti").select("page_id", "href")


def hreflang_reciprocity(alternates: DataFrame) -> DataFrame:
    """(url, href) of alternates (url, lang, href) whose target does not link back."""
    back = alternates.select(F.col("href").alias("url"), F.col("url").alias("href")).distinct()
    return alternates.where("url <> href").join(back, ["url", "href"], "left_anti").select("url", "href")


def heading_level_skips(audit: DataFrame) -> DataFrame:
    """(page_id, pos, level, previous): a heading more than one level below the one before it."""
    h = audit.select("page_id", F.posexplode("headings").alias("pos", "h")).withColumn("level", F.col("h.level"))
    return h.withColumn("previous", F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))).where("level > previous + 1").select("page_id", "pos", "level", "previous")


def _best(g: DataFrame, by: list[str], k: int) -> DataFrame:
    return g.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("shared").desc(), "target"))).where(F.col("_r") <= k).drop("_r")


#: Frequent words of a page whose subsets are keys; pages of more are met by each of their frequent words.
WIDE = 10


def _first(keys: DataFrame, n: int, salts: int = 64) -> DataFrame:
    """(host, key, target): the n least pages of each key; first of its parts, so that no key is one task's."""
    least = lambda d, *by: d.withColumn("_r", F.row_number().over(Window.partitionBy("host", "key", *by).orderBy("page_id"))).where(F.col("_r") <= n).drop("_r")
    parts = least(keys.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(salts))), "_salt")
    return least(parts).select("host", "key", F.col("page_id").alias("target"))


def link_candidates(pages: DataFrame, k: int = 6, common: int = 500) -> DataFrame:
    """(page_id, target, shared): up to k other pages of the host, of status 200 or 403 and ASCII address, by shared title words.

    Words that at most `common` pages of a host have meet by a join. The others, a few of each page, are the page's frequent words:
    every set of them is a key under which each host keeps its first k + 1 targets only. Of the pages that share just frequent words
    with a page, one that is among its k best stands among the first k + 1 of the set of words they share: all before it there share
    as much at least. So each page looks at the keys of its own sets, and no two pages meet otherwise. A page of more than WIDE
    frequent words has too many sets; it is met by each of its frequent words, whether it looks or is looked for. All joins are by
    shuffle: words, sets and pages grow with the input, and together they are more than a driver holds.
    pages: page_id, url, status, tokens.
    """
    words = landed(pages.select("page_id", "url", "status", host("url").alias("host"), F.array_distinct("tokens").alias("tokens")), "page-words")
    w = words.select("page_id", "host", F.explode("tokens").alias("w"))
    count = landed(w.groupBy("host", "w").agg(F.count("*").alias("n")), "page-word-counts")
    target = words.where(F.col("status").isin(200, 403) & F.col("url").rlike(r"^[\x21-\x7e]+$")).select(F.col("page_id").alias("target"), F.col("tokens").alias("theirs"))
    rare = w.join(by_shuffle(count.where(F.col("n").between(2, common)).select("host", "w")), ["host", "w"])
    met = rare.join(by_shuffle(rare.select("host", "w", F.col("page_id").alias("target"))), ["host", "w"]).select("page_id", "target")

    often = w.join(by_shuffle(count.where(F.col("n") > common).select("host", "w")), ["host", "w"])
    hot = landed(often.groupBy("host", "page_id").agg(F.sort_array(F.collect_list("w")).alias("hot")), "page-frequent-words")
    chosen = lambda m: F.array(*[F.when(m.bitwiseAND(1 << i) != 0, F.get("hot", F.lit(i))) for i in range(WIDE)])
    sets = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("hot")).cast("int") - 1), lambda m: F.array_join(chosen(m), "\u0001"))
    keys = hot.where(F.size("hot") <= WIDE).select("host", "page_id", F.explode(sets).alias("key"))
    first = _first(keys.join(by_shuffle(target.select(F.col("target").alias("page_id"))), "page_id"), k + 1)
    met = met.unionByName(keys.join(by_shuffle(first), ["host", "key"]).select("page_id", "target"))
    wide = hot.where(F.size("hot") > WIDE).select("host", "page_id", F.explode("hot").alias("w"))
    across = wide.join(by_shuffle(often.select("host", "w", F.col("page_id").alias("target"))), ["host", "w"]).select("page_id", "target")
    met = met.unionByName(across).unionByName(across.select(F.col("target").alias("page_id"), F.col("page_id").alias("target"))).where("page_id <> target").distinct()

    both = met.join(by_shuffle(words.select("page_id", "tokens")), "page_id").join(by_shuffle(target), "target")
    return _best(both.select("page_id", "target", F.size(F.array_intersect("tokens", "theirs")).cast("long").alias("shared")), ["page_id"], k)


#: Types of schema.org that an article is.
ARTICLES = ["Article", "NewsArticle", "BlogPosting"]


def geo_score(audit: DataFrame) -> DataFrame:
    """(page_id, geo_score): a point each for an answer in the first paragraph, a summary, five questions, the schemas Article,
    FAQPage and BreadcrumbList, five internal links, three keywords, a table and two lists; up to two for definitions and for
    boxes; 15 at most."""
    b = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    part = lambda k: F.col(f"structure.{k}")
    schema = lambda *types: F.arrays_overlap("schema_types", F.array(*[F.lit(t) for t in types]))
    questions = F.size(F.filter("headings", lambda h: h["text"].endswith("?")))
    points = [
        b(part("lead_words").between(1, 80)), F.least(part("definitions"), F.lit(2)), F.least(part("boxes"), F.lit(2)), b(_content()["has_summary"]), b(questions >= 5), b(schema(*ARTICLES)), b(schema("FAQPage")),
        b(schema("BreadcrumbList")), b(_links()["internal_unique"] >= 5), b(F.size(F.split("keywords", r"\s*,\s*")) >= 3), b(part("tables") >= 1), b(part("lists") >= 2),
    ]
    return audit.select("page_id", F.least(sum(points, F.lit(0)), F.lit(15)).alias("geo_score"))


def duplicate_cards(cards: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """(page_id, card_id, n): product cards that a page repeats, identical in name and price, but for the expected ones."""
    g = cards.groupBy("page_id", "card_id", "name", "price").agg(F.count("*").alias("n")).where("n > 1")
    return g.where(~F.col("card_id").isin(expected or [])).select("page_id", "card_id", "n")


def robots_access(robots: DataFrame, bots: list[str]) -> DataFrame:
    """(host, bot, access): allowed, blocked or unknown at the root, for robots(host, body); doubt is unknown."""

    @F.pandas_udf(StringType())
    def root(body: pd.Series, bot: pd.Series) -> pd.Series:
        return pd.Series([root_access(b, x) for b, x in zip(body, bot, strict=True)])

    return robots.withColumn("bot", F.explode(F.array(*[F.lit(b) for b in bots]))).select("host", "bot", root("body", "bot").alias("access"))


def root_access(body: str | None, bot: str) -> str:
    """Access of one bot to / under one robots.txt: groups by named agent, then by *; wildcards, several groups for the same
    agent, an empty named group, and both rules for / are in doubt."""
    groups: list[tuple[set[str], list[tuple[str, str]]]] = []
    fresh = True
    for line in (body or "").splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not fresh or not groups:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            fresh = True
        elif key in ("allow", "disallow") and groups:
            groups[-1][1].append((key, value))
            fresh = False
    low = bot.lower()
    own = [g for g in groups if any(a != "*" and a and a in low for a in g[0])] or [g for g in groups if "*" in g[0]]
    if not own:
        return "allowed"
    rules = own[0][1]
    named = any(a != "*" for a in own[0][0])
    if len(own) > 1 or (named and not rules) or any("*" in p or "$" in p for _, p in rules):
        return "unknown"
    at_root = {k for k, p in rules if p == "/"}
    if len(at_root) > 1:
        return "unknown"
    return "blocked" if at_root == {"disallow"} else "allowed"
