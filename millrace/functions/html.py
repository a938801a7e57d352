"""Web pages: titles, clean-up, main content, Markdown, links, URL audits."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
import re
from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pieces

# Hints in attributes of main content and of the rest, tags, least score; schemes of links.
MAIN = re.compile(
    r"(cnblogs_post_body|post_body|article[-_]?content|entry[-_]?content|"
    r"post[-_]?content|blog[-_]?post|blogpost|main[-_]?content|content[-_]?main|"
    r"page[-_]?content|rich_media_content|js_content|post[-_]?entry|"
    r"content[-_]?body|article|single[-_]?content|topic[-_]?content)"
)
REST = re.compile(
    r"(comment|footer|sidebar|related|recommend|advert|ads?[_-]?|nav|menu|"
    r"widget|share|pagination|breadcrumb|meta|info[-_]?box|toolbar|header)",
    re.I,
)
REST_INSIDE = re.compile(
    r"<[a-z]+\b[^>]*(?:id|class)=[\"'][^\"']*(?:comment|footer|sidebar|"
    r"related|recommend|advert|ads?[_-]?|\bnav\b|widget|pagination|breadcrumb)"
    r"[^\"']*[\"']",
    re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\s[^<>]*?)?)(/?)>", re.S)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEAST = 120
SCHEMES = ("http", "https", "mailto", "tel", "ftp")


def page_title(page: Column) -> Column:
    """The first title, white space collapsed, 200 characters at most; empty if there is none."""
    found = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, 200)


def strip_chrome(page: Column) -> Column:
    """A page without comments, scripts and styles."""
    return F.regexp_replace(F.regexp_replace(page, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")


def scored(page: str) -> list[tuple[int, int, int]]:
    """(start, end, score) of a page's elements that may be its main content.

    All counts are running sums over the page, so nested candidates cost no second look at their text.
    """
    starts, ends, chars, words = [], [], [0], [0]
    open_tags: dict[str, list[int]] = {}
    found: list[list[int]] = []
    before = 0
    for m in TAG.finditer(page):
        own = page[before : m.start()].split()
        chars.append(chars[-1] + sum(map(len, own)))
        words.append(words[-1] + len(own))
        starts.append(m.start())
        ends.append(m.end())
        before, tag, place = m.end(), m[2].lower(), len(starts) - 1
        if m[1]:
            if mine := open_tags.get(tag):
                at = mine.pop()
                if at >= 0:
                    found[at][1:] = [m.end(), place]
            continue
        if m[4] or tag in VOID:
            continue
        wanted = tag == "article" or tag in ("div", "section", "main") and MAIN.search(m[3]) and not REST.search(m[3])
        open_tags.setdefault(tag, []).append(len(found) if wanted else -1)
        if wanted:
            found.append([place, len(page), -1])
    own = page[before:].split()
    chars.append(chars[-1] + sum(map(len, own)))
    words.append(words[-1] + len(own))
    paragraphs = [m.start() for m in re.finditer("<p", page)]
    headings = [m.start() for m in re.finditer(r"<h[1-3][\s>]", page, re.I)]
    rest = [m.start() for m in REST_INSIDE.finditer(page)]

    def number(places: list[int], start: int, end: int) -> int:
        return bisect_left(places, end) - bisect_left(places, start)

    out = []
    for place, end, last in found:
        upto = (last if last >= 0 else len(starts)) + 1
        plain = chars[upto] - chars[place + 1] + max(0, words[upto] - words[place + 1] - 1)
        start = starts[place]
        out.append((start, end, plain + 25 * number(paragraphs, start, end) + 30 * number(headings, start, end) - 150 * number(rest, start, end)))
    return out


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, start, end, score) of every element that may be a page's main content."""

    def run(batches):
        for batch in batches:
            rows = [(key, *x) for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in scored(page or "")]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["page_id", "start", "end", "score"])

    return pages.select(F.col("page_id").cast("long"), strip_chrome(F.col("html")).alias("html")).mapInArrow(run, "page_id long, start long, end long, score long")


def main_content(pages: DataFrame) -> DataFrame:
    """(page_id, content, extracted): the best element if it scores enough, the first of equals, else the whole page."""
    best = candidates(pages).filter(F.col("score") >= LEAST).groupBy("page_id").agg(F.max_by(F.struct("start", "end"), F.struct("score", -F.col("start"))).alias("best"))
    page = strip_chrome(F.col("html"))
    whole = pages.select("page_id", page.alias("page")).join(best, "page_id", "left")
    content = F.when(F.col("best").isNotNull(), F.substr("page", (F.col("best.start") + 1).cast("int"), (F.col("best.end") - F.col("best.start")).cast("int"))).otherwise(F.col("page"))
    return whole.select("page_id", content.alias("content"), F.col("best").isNotNull().alias("extracted"))


def extraction_rates(pages: DataFrame) -> DataFrame:
    """T21 as a job: pages by host, those whose main content was found, and its characters."""
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)), F.lit("")), F.lit("unknown"))
    found = main_content(pages).join(pages.select("page_id", host.alias("host")), "page_id")
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if("extracted").alias("extracted"), F.coalesce(F.sum(F.when(F.col("extracted"), F.length("content"))), F.lit(0)).cast("long").alias("chars"))


def _safe(url: str, base: str) -> str:
    """A link's target against a base, empty if its scheme isn't allowed."""
    from urllib.parse import urljoin, urlsplit

    url = re.sub(r"[\x00-\x20]+", "", url or "")
    try:
        url = urljoin(base, url) if base else url
        scheme = urlsplit(url).scheme.lower()
    except ValueError:
        return ""
    return url if not scheme or scheme in SCHEMES else ""


BLOCKS = ("headings", "paragraphs", "lists", "tables", "code", "quotes", "links", "images", "rules")


class _Markdown(HTMLParser):
    """Markdown of a page: a stack of text buffers, one for each open element that wraps its text."""

    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}
    SKIPPED = {"script", "style", "head", "noscript", "template", "svg"}

    def __init__(self, base: str, tables: bool):
        super().__init__(convert_charrefs=True)
        self.base, self.with_tables = base, tables
        self.stack: list[tuple[str, dict, list[str]]] = [("", {}, [])]
        self.skip, self.pre, self.language = 0, 0, None
        self.lists: list[list] = []
        self.blocks = dict.fromkeys(BLOCKS, 0)

    def _out(self, text: str) -> None:
        self.stack[-1][2].append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "br":
            self._out("\n" if self.pre else "  \n")
        elif tag == "hr":
            self.blocks["rules"] += 1
            self._out("\n\n---\n\n")
        elif tag == "img":
            if src := _safe(a.get("src") or "", self.base):
                self.blocks["images"] += 1
                self._out(f"![{a.get('alt') or ''}]({src})")
        elif tag not in VOID:
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            self.pre += tag == "pre"
            self.stack.append((tag, a, []))

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip or not any(t == tag for t, _, _ in self.stack):
            return
        while len(self.stack) > 1:
            t, a, parts = self.stack.pop()
            self._close(t, a, "".join(parts))
            if t == tag:
                break

    def close(self):
        super().close()
        while len(self.stack) > 1:
            t, a, parts = self.stack.pop()
            self._close(t, a, "".join(parts))

    def handle_data(self, data):
        if not self.skip:
            self._out(data if self.pre else re.sub(r"\s+", " ", data))

    def _close(self, tag: str, a: dict, text: str) -> None:
        bare = text.strip()
        if re.fullmatch("h[1-6]", tag):
            if bare:
                self.blocks["headings"] += 1
                self._out(f"\n\n{'#' * int(tag[1])} {bare}\n\n")
        elif tag in ("p", "div", "section", "article", "main", "header", "footer", "figure"):
            self.blocks["paragraphs"] += tag == "p" and bool(bare)
            self._out(f"\n\n{bare}\n\n" if bare else "")
        elif tag in self.MARKS:
            self._out(f"{self.MARKS[tag]}{bare}{self.MARKS[tag]}" if bare else text)
        elif tag == "a":
            url = _safe(a.get("href") or "", self.base)
            self.blocks["links"] += bool(url and bare)
            self._out(f"[{bare}]({url})" if url and bare else text)
        elif tag == "code":
            self.language = re.search(r"lang(?:uage)?-([\w+#-]+)", a.get("class") or "") or self.language
            self._out(text if self.pre else f"`{bare}`")
        elif tag == "pre":
            self.pre -= 1
            self.blocks["code"] += 1
            language = re.search(r"lang(?:uage)?-([\w+#-]+)", a.get("class") or "") or self.language
            self.language = None
            body = text.strip("\n")
            self._out(f"\n\n```{language[1] if language else ''}\n{body}\n```\n\n")
        elif tag == "blockquote":
            self.blocks["quotes"] += 1
            self._out("\n\n" + "\n".join(f"> {x}".rstrip() for x in _tidy(text).split("\n")) + "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            rows = re.sub(r"\n{2,}", "\n", _tidy(text)).split("\n")
            self._out("\n" + mark + ("\n" + " " * len(mark)).join(rows))
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.blocks["lists"] += 1
            self._out(f"\n{text.strip(chr(10))}\n" if self.lists else f"\n\n{text.strip(chr(10))}\n\n")
        elif tag in ("td", "th"):
            self._out(re.sub(r"\s+", " ", bare).replace("|", "\\|") + "\x1f")
        elif tag == "tr":
            self._out(text.replace("\n", " ").strip(" ") + "\x1e")
        elif tag == "table":
            self._table(text)
        else:
            self._out(text)

    def _table(self, text: str) -> None:
        rows = [[c.strip() for c in r.strip().rstrip("\x1f").split("\x1f")] for r in text.split("\x1e") if "\x1f" in r]
        if not rows:
            return
        self.blocks["tables"] += 1
        if not self.with_tables:
            self._out("\n\n" + "\n".join(" ".join(r) for r in rows) + "\n\n")
            return
        wide = max(map(len, rows))
        rows = [r + [""] * (wide - len(r)) for r in rows]
        width = [max(3, *(len(r[i]) for r in rows)) for i in range(wide)]
        shown = ["| " + " | ".join(c.ljust(n) for c, n in zip(r, width, strict=True)) + " |" for r in rows]
        shown.insert(1, "| " + " | ".join("-" * n for n in width) + " |")
        self._out("\n\n" + "\n".join(shown) + "\n\n")


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t]+\n", lambda m: "  \n" if m[0].startswith("  \n") else "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def markdown(page: str, base: str = "", tables: bool = True) -> tuple[str, dict[str, int]]:
    """A page as Markdown, and its blocks by kind."""
    parser = _Markdown(base, tables)
    parser.feed(page)
    parser.close()
    return _tidy("".join(parser.stack[0][2])), parser.blocks


def html_to_markdown(pages: DataFrame, tables: bool = True) -> DataFrame:
    """(page_id, markdown, input_chars, output_chars, blocks); links are resolved against the page's url."""

    def run(batches):
        for batch in pieces(batches):
            pages_, urls = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            done = [markdown(p or "", u or "", tables) for p, u in zip(pages_, urls, strict=True)]
            blocks = pa.array([list(b.items()) for _, b in done], pa.map_(pa.string(), pa.int32()))
            yield pa.record_batch([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(p or "") for p in pages_], pa.int32()), pa.array([len(t) for t, _ in done], pa.int32()), blocks], ["page_id", "markdown", "input_chars", "output_chars", "blocks"])

    return pages.select(F.col("page_id").cast("long"), "html", "url").mapInArrow(run, "page_id long, markdown string, input_chars int, output_chars int, blocks map<string,int>")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, target) of hrefs and srcs, resolved against the page's url; unsafe schemes are dropped."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)\s(?:href|src)\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s"'>]+)"""), F.lit(0))
    each = pages.select("page_id", "url", F.posexplode(found).alias("pos", "raw"))
    link = F.regexp_replace(F.regexp_replace("raw", r"""(?i)^\s(?:href|src)\s*=\s*["']?""", ""), r"""["']$""", "")
    link = F.regexp_replace(F.replace(link, F.lit("&amp;"), F.lit("&")), r"[\x00-\x20]+", "")
    each = each.withColumn("link", link)
    scheme = F.lower(F.regexp_extract("link", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    origin = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract("url", r"^([^?#]*)", 1), r"(?<![:/])/[^/]*$", "")
    bare = F.regexp_extract("url", r"^([^#]*)", 1)
    target = F.when(scheme != "", F.when(scheme.isin(*SCHEMES), F.col("link"))).when(F.col("link") == "", F.col("url")).when(F.col("link").startswith("//"), F.concat(F.regexp_extract("url", r"^([A-Za-z]+:)", 1), "link")).when(F.col("link").startswith("/"), F.concat(origin, "link")).when(F.col("link").startswith("#"), F.concat(bare, "link")).when(F.col("link").startswith("?"), F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), "link")).otherwise(F.concat(folder, F.lit("/"), "link"))
    return each.select("page_id", "pos", target.alias("target")).filter("target is not null")


def host_degrees(pages: DataFrame) -> DataFrame:
    """Links out of and into each host."""
    edges = links(pages).join(pages.select("page_id", "url"), "page_id").select(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("from"), F.regexp_extract("target", r"^[a-z]+://([^/?#:]+)", 1).alias("to"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("from").alias("host"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("to").alias("host"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    return ends.filter("e.host <> ''").groupBy(F.col("e.host").alias("host")).agg(F.sum("e.out").alias("out_links"), F.sum("e.in").alias("in_links"))


# Blocks of addresses that aren't globally reachable, the parts of these that are, and what else is refused.
PRIVATE4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"]
GLOBAL4, SHARED4, MULTICAST4 = ["192.0.0.9/32", "192.0.0.10/32"], ["100.64.0.0/10"], ["224.0.0.0/4"]
PRIVATE6 = ["::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"]
GLOBAL6, MULTICAST6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"], ["ff00::/8"]


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _within(address: Column, blocks: list[str]) -> Column:
    """Whether an address, in hexadecimal digits of full length, lies in one of the blocks."""
    found = F.lit(False)
    for net in map(ipaddress.ip_network, blocks):
        width = 8 if net.version == 4 else 32
        found |= address.between(f"{int(net.network_address):0{width}x}", f"{int(net.broadcast_address):0{width}x}")
    return found


def ipv4_hex(host: Column) -> Column:
    """The eight hexadecimal digits of a dotted address without leading zeros; null for anything else."""
    part = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    digits = [F.lpad(F.lower(F.hex(F.regexp_extract(host, rf"^{r'\.'.join([part] * 4)}$", i).cast("long"))), 2, "0") for i in range(1, 5)]
    return F.when(host.rlike(rf"^{r'\.'.join([part] * 4)}$"), F.concat(*digits))


def ipv6_hex(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address (`::`, a dotted end and a zone allowed); null for anything else."""
    plain = F.regexp_replace(F.lower(host), "%.*$", "")
    tail = ipv4_hex(F.regexp_extract(plain, r":([\d.]+)$", 1))
    dotted = _once(tail, lambda t: F.concat(F.regexp_extract(plain, r"^(.*:)[\d.]+$", 1), F.left(t, F.lit(4)), F.lit(":"), F.right(t, F.lit(4))))
    groups = lambda x: F.transform(F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

    def digits(x: Column, halves: Column, left: Column, right: Column) -> Column:
        zeros = 8 - F.size(left) - F.size(right)
        fine = x.rlike("^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,8}$") & ~x.rlike(":::|^:[^:]|[^:]:$") & (F.size(halves) <= 2) & F.when(F.size(halves) == 2, zeros >= 1).otherwise(zeros == 0)
        return F.when(fine, F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), F.greatest(zeros, F.lit(0))), F.array_join(right, "")))

    parts = lambda x: _once(F.split(x, "::"), lambda h: _once(groups(F.get(h, F.lit(0))), lambda a: _once(groups(F.get(h, F.lit(1))), lambda b: digits(x, h, a, b))))
    return F.when(host.contains(":"), _once(F.when(plain.contains("."), dotted).otherwise(plain), parts))


def refused_address(host: Column) -> Column:
    """Whether a literal address isn't global, or is multicast or unspecified; false for names. IPv4 in IPv6 counts by its block alone."""
    private = lambda x: _within(x, PRIVATE4) & ~_within(x, GLOBAL4)
    four = _once(ipv4_hex(host), lambda x: F.when(x.isNotNull(), private(x) | _within(x, SHARED4 + MULTICAST4)))
    mapped = "0" * 20 + "ffff"
    six = _once(ipv6_hex(host), lambda x: F.when(x.startswith(mapped), _once(F.right(x, F.lit(8)), private)).otherwise(_within(x, PRIVATE6) & ~_within(x, GLOBAL6) | _within(x, MULTICAST6)))
    return F.coalesce(four, six, F.lit(False))


def url_verdict(url: Column) -> Column:
    """Ok, or why a URL is refused: scheme, host (missing, or no address in its brackets), localhost or address. Names are not resolved."""
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_replace(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^[^@]*@", "")
    bracketed = authority.startswith("[")
    named = F.lower(F.when(bracketed, F.regexp_extract(authority, r"^\[([^\]]*)", 1)).otherwise(F.regexp_replace(authority, r":\d*$", "")))

    def verdict(host: Column) -> Column:
        local = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")
        no_host = (host == "") | bracketed & ipv6_hex(host).isNull()
        return F.when(F.coalesce(~scheme.isin("http", "https"), F.lit(True)), "scheme").when(no_host, "host").when(local, "localhost").when(refused_address(host), "address").otherwise("ok")

    return _once(F.regexp_replace(named, r"\.$", ""), verdict)


def url_audit(pages: DataFrame) -> DataFrame:
    """T24 as a job: pages by verdict."""
    return pages.groupBy(url_verdict(F.col("url")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
