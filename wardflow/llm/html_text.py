"""Main text of web pages, by equivalence classes of tokens over the pages of a host.

A page is read as a row of tokens: the tags of its block elements, each told apart by its path (names, classes
and ids of the elements around it, digits dropped), and the blocks of text between them. For every host

1. each token has an occurrence vector: how often it stands in each page. Vectors are compared by sums of hashes
   of the pages, so they are partial aggregates and never gathered;
2. tags with one vector form an equivalence class. A class is valid if its tags come in one order on every
   page, over and over, and its spans nest with those of the other classes;
3. the valid classes, nested, are the template. A slot is what follows one of its tags, up to the next one on
   the same level. Blocks whose own token stands on half of the pages or more are fixed text of the template;
4. slots are judged over all pages of the host: words, words in links, fixed words. What remains is extracted.

Which slots hold the article: those in an `article` element (else `main`, else anywhere) that are not inside
elements whose name, role, class or id says menu, header, footer, sidebar, notice, advert, form, script, style
or reader comments. Slots of fixed text only leave where the host's text varies otherwise; outside of article and
main, slots that are mostly links leave too. Nothing else leaves, whatever its length. Character references are
decoded, white space in a block is one space, blocks are joined by one line feed.

Classes are kept where their tags stand on 1 / `rare` of the host's distinct pages (20) and on two at least (or on
the only one), so a host's template has at most `rare` times as many tags as a page has on average, and fixed
blocks are at most twice as many as a page has; only these are brought to the pages of the host, by a join that
Spark may broadcast or split. A host with any share of the pages is spread over many tasks in every step.

Defined results: null and empty html give an empty text; a null url is a host of its own name (empty); repeated
rows are rows of the result each; copies of one page count once in the template; a page that ends in the middle of
a tag, script or comment ends there; other columns are not read.
"""

import html as codec
import re

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from wardflow.llm.common import ship, slices, staged, tidy

RARE = 20

# Fixed values of HTML: elements without content, with raw content, with a box of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
            "summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
WALLS = {"td", "th", "caption", "table", "button", "body"}

# What the names of elements say about a slot.
ASIDE = set("nav aside footer menu dialog button select label fieldset search".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
WORDS = set("nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer header masthead ad ads advert adverts "
            "advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal "
            "newsletter subscribe subscription signup login share sharing social related recommended widget comment comments "
            "disqus reply replies respond pagination pager toolbar copyright search form".split())
PLAIN = {"html", "body", "main"}

TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|"
                 r"<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

_attributes = {}


def _about(name, raw):
    """(signature, says): an element's name, classes and id without digits; 2 if they say that it is no article."""
    key = (name, raw)
    if key not in _attributes:
        if len(_attributes) > 50_000:
            _attributes.clear()
        sign, says = name, 2 if name in ASIDE else 0
        for kind, value in ATTRIBUTE.findall(raw):
            kind, value = kind.lower(), value.strip("\"'")
            if kind == "role":
                says = 2 if value.lower() in ROLES and name not in PLAIN else says
                continue
            sign += f" {kind}={re.sub(r'[0-9]+', '', value.lower())}"
            if name == "article":  # such as "post comments-open" is an article, "comment" is not
                words = value.lower().split() if kind == "class" else []
            else:
                words = [] if name in PLAIN else NAME.findall(CAMEL.sub(" ", value).lower())
            if not WORDS.isdisjoint(words):
                says = 2
        _attributes[key] = sign, says
    return _attributes[key]


def walk(html):
    """Tokens of a page: (token, text, words, words in links, aside, region) with no text for tags.

    Tags have tokens of 0 or more, blocks of text negative ones. Aside: 1 where the elements around are no
    article. Region: 2 in an article element, 1 in main, else 0.
    """
    out, parts, linked = [], [], 0
    # name, path, aside (1: unless an article is inside, 2), region, in a link, is a block
    stack = [("", 0, 0, 0, False, True)]
    here = {}  # open elements by name
    base = stack[0]  # innermost block element

    def flush():
        nonlocal linked
        words = "".join(parts).split()
        if words:
            text = " ".join(words)
            token = -1 - (xxhash.xxh3_64_intdigest(text, base[1] & 0xFFFFFFFF) >> 2)
            out.append((token, text, len(words), linked, int(base[2] > 0), base[3]))
        parts.clear()
        linked = 0

    def pop(upto):
        nonlocal base
        for entry in stack[upto:]:
            here[entry[0]] -= 1
        del stack[upto:]
        base = next(e for e in reversed(stack) if e[5])

    def find(names, walls):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in walls:
                return 0
        return 0

    at, end = 0, len(html)
    while at < end:
        tag = TAG.search(html, at)
        stop = tag.start() if tag else end
        if stop > at and stack[-1][2] == base[2]:  # not where an inline element alone is aside
            text = codec.unescape(html[at:stop])
            parts.append(text)
            if stack[-1][4]:
                linked += len(text.split())
        if not tag:
            break
        at = tag.end()
        if not tag.group(2):
            continue
        name, closing = tag.group(2).lower(), tag.group(1)
        block = name in BLOCK
        if block or name == "br":
            if block:
                flush()
            else:
                parts.append(" ")
        if closing:
            if here.get(name):
                upto = find({name}, WALLS - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else ()) \
                    if block else find({name}, BLOCK)
                if upto:
                    if block:
                        out.append((2 * stack[upto][1] + 1, None, 0, 0, 0, 0))
                    pop(upto)
            continue
        if block and here.get("p"):
            upto = find({"p"}, WALLS)
            if upto:
                pop(upto)
        if name in CLOSES and any(here.get(n) for n in CLOSES[name][0]):
            upto = find(*CLOSES[name])
            if upto:
                pop(upto)
        if name in RAW:
            if not tag.group(3).rstrip(">").endswith("/"):
                close = END[name].search(html, at)
                at = close.start() if close else end
                if close:
                    at = TAG.search(html, at).end()
            continue
        if name in VOID:
            continue
        sign, says = _about(name, tag.group(3).rstrip(">"))
        _, path, aside, region, link, _ = stack[-1]
        if block:
            path = xxhash.xxh3_64_intdigest(sign, path & 0xFFFFFFFFFFFFFFFF) >> 2
            out.append((2 * path, None, 0, 0, 0, 0))
        if name in ("article", "main"):
            aside, region = (0 if aside == 1 else aside), max(region, 2 if name == "article" else 1)
        aside = max(aside, says, int(name == "form" or name == "header" and not region))
        entry = (name, path, aside, region, link or name == "a", block)
        stack.append(entry)
        here[name] = here.get(name, 0) + 1
        if block:
            base = entry
    flush()
    return out


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TOKENS = ("host string, digest long, tokens array<long>, words array<int>, links array<int>, aside array<byte>, region array<byte>")


def _read(batches):
    for batch in batches:
        for part in slices(batch, "html"):
            columns, bounds = [[] for _ in range(5)], [0]
            for html in part.column("html").to_pylist():
                for token, _, *rest in walk(html):
                    columns[0].append(token)
                    for column, value in zip(columns[1:], rest):
                        column.append(value)
                bounds.append(len(columns[0]))
            bounds = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(c, t)) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.int8()))]
            yield pa.RecordBatch.from_arrays([part.column("host").cast(pa.string()), part.column("digest"), *lists],
                                             ["host", "digest", "tokens", "words", "links", "aside", "region"])


def _orders(tokens, classes):
    """Per class: its tags in the order of their first occurrence here."""
    found = {}
    for t in tokens:
        c = classes.get(t)
        if c is not None:
            found.setdefault(c, {}).setdefault(t, len(found[c]))
    return found


def _soundness(tokens, classes):
    """Per class on this page: (a hash of its order, whether it is one order over and over and nests)."""
    orders, due, bad, stack = _orders(tokens, classes), {}, set(), []
    for t in tokens:
        c = classes.get(t)
        if c is None:
            continue
        place = orders[c][t]
        if place != due.get(c, 0):
            bad.add(c)
            continue
        due[c] = (place + 1) % len(orders[c])
        if c in bad:
            continue
        if place:
            while stack and stack[-1] != c:  # begun in this gap and not finished
                bad.add(stack.pop())
        else:
            stack.append(c)
        if stack and place + 1 == len(orders[c]):
            stack.pop()
    bad.update(c for c, d in due.items() if d)
    return [(c, xxhash.xxh3_64_intdigest(repr(list(order))) >> 1, c not in bad) for c, order in orders.items()]


def _slots(tokens, classes):
    """For every token, the slot it stands in: the last tag of the innermost open class, 0 outside of all."""
    orders, stack, out = _orders(tokens, classes), [], []
    for t in tokens:
        c = classes.get(t)
        if c is None:
            out.append(stack[-1][1] if stack else 0)
            continue
        place = orders[c][t]
        while place and stack and stack[-1][0] != c:
            stack.pop()
        if place and stack:
            stack[-1] = (c, t)
        else:
            stack.append((c, t))
        out.append(t)
        if place + 1 == len(orders[c]):
            stack.pop()
    return out


def _level(aside, region):
    """The region that the article of a page is read from."""
    return max((r for a, r in zip(aside, region) if not a), default=0)


def _template(batch, cache):
    """Per row: (class by tag, fixed blocks, dropped slots) of its host, made once per host and batch."""
    names = [n for n in ("classes", "fixed", "dropped") if n in batch.schema.names]
    for i, host in enumerate(batch.column("host").to_pylist()):
        if host not in cache:
            row = {n: batch.column(n)[i].as_py() or [] for n in names}
            cache[host] = ({t: c["class"] for c in row["classes"] for t in c["tags"]}, set(row.get("fixed", ())),
                           set((d["slot"], d["inner"]) for d in row.get("dropped", ())))
        yield cache[host]


def _check(batches):
    for batch in batches:
        out = []
        for host, tokens, (classes, _, _) in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), _template(batch, {})):
            out += [(host, *found) for found in _soundness([t for t in tokens if t >= 0], classes)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))],
                                             ["host", "class", "order", "sound"])


def _measure(batches):
    for batch in batches:
        sums = {}
        columns = [batch.column(n).to_pylist() for n in ("host", "tokens", "words", "links", "aside", "region")]
        for host, tokens, words, links, aside, region, (classes, fixed, _) in zip(*columns, _template(batch, {})):
            level = _level((a for a, w in zip(aside, words) if w), (r for r, w in zip(region, words) if w))
            for t, slot, n, k, a, r in zip(tokens, _slots(tokens, classes), words, links, aside, region):
                if n and not a and r >= level:
                    s = sums.setdefault((host, slot, level > 0), [0, 0, 0])
                    s[0] += n
                    s[1] += k
                    s[2] += n * (t in fixed)
        if sums:
            rows = [(*key, *value) for key, value in sums.items()]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             ["host", "slot", "inner", "words", "links", "fixed"])


def _extract(batches):
    for batch in batches:
        cache = {}
        for part in slices(batch, "html"):
            texts = []
            for html, (classes, _, dropped) in zip(part.column("html").to_pylist(), _template(part, cache)):
                tokens = walk(html)
                level = _level((t[4] for t in tokens if t[2]), (t[5] for t in tokens if t[2]))
                texts.append("\n".join(t[1] for t, slot in zip(tokens, _slots([t[0] for t in tokens], classes))
                                       if t[2] and not t[4] and t[5] >= level and (slot, level > 0) not in dropped))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def _deduce(pages, rare):
    """(templates, slots): per host its valid classes and fixed blocks; the judged slots, with `dropped`."""
    tokens = staged(pages.mapInArrow(tidy(_read), TOKENS), "tokens")
    cells = tokens.select("host", "digest", F.explode("tokens").alias("token")).groupBy("host", "digest", "token").agg(F.count("*").alias("n"))
    low, high = F.col("digest").bitwiseAND(0x7FFFFFFF), F.shiftright("digest", 31).bitwiseAND(0x7FFFFFFF)
    vectors = cells.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("total"),
                                                 F.sum(F.col("n") * low).alias("low"), F.sum(F.col("n") * high).alias("high"))
    sizes = staged(tokens.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("of")), "hosts")
    often = vectors.join(sizes, "host").filter("pages >= least(2, of)").filter(F.col("pages") * rare >= F.col("of"))
    often = staged(often, "frequent")
    classes = often.filter("token >= 0").groupBy("host", F.xxhash64("pages", "total", "low", "high").alias("class")).agg(
        F.sort_array(F.collect_list("token")).alias("tags")).filter("size(tags) > 1")  # bounded: see the docstring
    classes = staged(classes, "classes")
    template = classes.groupBy("host").agg(F.collect_list(F.struct("class", "tags")).alias("classes"))
    sound = tokens.select("host", "tokens").join(template, "host").mapInArrow(
        tidy(_check), "host string, class long, order long, sound boolean").groupBy("host", "class").agg(
        F.min("order").alias("a"), F.max("order").alias("z"), F.min("sound").alias("sound")).filter("sound AND a = z")
    classes = staged(classes.join(sound, ["host", "class"], "left_semi"), "valid")
    template = classes.groupBy("host").agg(F.collect_list(F.struct("class", "tags")).alias("classes"))
    fixed = often.filter("token < 0 AND of >= 3 AND 2 * pages >= of").groupBy("host").agg(F.collect_list("token").alias("fixed"))
    template = staged(sizes.join(template, "host", "left").join(fixed, "host", "left"), "templates")
    slots = tokens.drop("digest").join(template, "host").mapInArrow(
        tidy(_measure), "host string, slot long, inner boolean, words long, links long, fixed long")
    slots = staged(slots.groupBy("host", "slot", "inner").agg(*(F.sum(c).alias(c) for c in ("words", "links", "fixed"))), "slots")
    whole = slots.groupBy("host", "inner").agg((2 * F.sum("fixed") < F.sum("words")).alias("varied"))
    only_fixed = F.col("varied") & F.when(F.col("inner"), 100 * F.col("fixed") >= 99 * F.col("words")).otherwise(
        10 * F.col("fixed") >= 9 * F.col("words"))
    return template, slots.join(whole, ["host", "inner"]).withColumn(
        "dropped", only_fixed | (~F.col("inner") & (2 * F.col("links") >= F.col("words"))))


def _pages(pages, *columns):
    html = F.coalesce("html", F.lit(""))
    return pages.select(*columns, _host(F.col("url")).alias("host"), F.xxhash64(html).alias("digest"), html.alias("html"))


def templates(pages, rare=RARE):
    """The slots found: host, slot (the tag before it), inner (in an article or main), words, links, fixed, dropped."""
    ship(pages.sparkSession)
    return _deduce(_pages(pages), rare)[1].drop("varied")


def main_text(pages, rare=RARE):
    """page_id, url, text and n_chars (code points) of every page."""
    ship(pages.sparkSession)
    template, slots = _deduce(_pages(pages), rare)
    dropped = slots.filter("dropped").groupBy("host").agg(F.collect_list(F.struct("slot", "inner")).alias("dropped"))
    template = staged(template.select("host", "classes").join(dropped, "host", "left"), "final")
    return _pages(pages, "page_id", "url").drop("digest").join(template, "host", "left").mapInArrow(
        tidy(_extract), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
