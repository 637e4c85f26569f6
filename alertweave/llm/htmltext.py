"""Main text of web pages by consensus paths of their host.

Pass 1 scores each page's containers and turns their place in the tree into a
generalised path of tags and classes (digits become '#'; a hash stands for it). The pages of a host
vote: a container's vote is its score as a share of the page's best, and the
path with the largest sum wins. Pass 2 re-extracts each page from the containers
on its host's winning path, or from its own best one where none is there, and
from what belongs to the same article around them (`Page.widened`): titles,
leads, sections and closing paragraphs at other levels of nesting.

Defined cases: null or empty html gives an empty text; a page without a host (null
or odd url) uses its own best container; page_id and url may repeat; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import stored

# fixed values: HTML element names by behaviour
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title select xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
#: An opening tag on the left closes open ones on the right, up to their list or table.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# fixed values: what is not article, by tag, role, and words of class or id
SKIPPED_TAGS = frozenset("nav footer aside button dialog menu head".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar sidenav rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall "
    "share sharing social related recommended recommendations trending popular widget pagination pager login search copyright disclaimer skip tags".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion respond reply replies responses feedback".split())
CONTENT_WORDS = frozenset("content article post entry story body text main".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
#: Unclosed, these hide the rest of a page, as scripts and styles are no text; the others then count as a tag alone.
_OPAQUE = frozenset("script style".split())
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tags:
    """Tags of a page from left to right, in time proportional to its length.

    A '>' within quotes does not end a tag. Where such a reading of a tag meets the end
    of the page, quotes mean nothing from that tag on, so no part is read again and again.
    """

    def __init__(self, source: str):
        self.source, self.last, self.quotes = source, source.rfind(">"), True
        self.unclosed: set[str] = set()

    def _end(self, at: int) -> int:
        """Place of the '>' that ends the tag whose name ends at `at`; there is one."""
        place = at
        while self.quotes:
            place = _PLAIN.match(self.source, place).end()
            if place == len(self.source):
                break
            if self.source[place] == ">":
                return place
            place = self.source.find(self.source[place], place + 1) + 1
            if not place:
                break
        self.quotes = False
        return self.source.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(begin, end, name, whether an end tag, attributes) of the first tag from `at`; comments and declarations have no name."""
        source = self.source
        while (begin := source.find("<", at)) >= 0:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(source), "", False, ""
            if begin > self.last:
                return None
            if source.startswith(("<!", "<?"), begin):
                return begin, source.find(">", begin) + 1, "", False, ""
            closing = source.startswith("/", begin + 1)
            name = _NAME.match(source, begin + 1 + closing)
            if name and (end := self._end(name.end())) >= 0:
                return begin, end + 1, name[0].lower(), closing, source[name.end() : end]
            at = begin + 1
        return None

    def after(self, name: str, at: int) -> int:
        """Place behind the end tag of a raw element, -1 if there is none from `at` on."""
        if name in self.unclosed:
            return -1
        found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.source, at)
        if not found:
            self.unclosed.add(name)
        return found.end() if found else -1


class Page:
    """Elements of a page in parallel lists, and its texts in order with the element they lie in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind, self.path, self.skip = ["#page"], [-1], ["#page"], [0], [False]
        #: words of furniture; areas of comments or forms that may be the page itself; inside a link, inside article or main
        self.soft, self.area, self.in_link, self.in_article = [False], [""], [False], [False]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self._read(source)
        self._settle()
        self._weigh()

    def _read(self, source: str) -> None:
        stack, at, tags = [0], 0, Tags(source)
        # how often each name is open, so that end tags of nothing are passed over at once
        opened: Counter[str] = Counter()

        def close(to: int) -> None:
            if any(self.tag[e] not in INLINE for e in stack[to:]):
                self.block += 1
            opened.subtract(self.tag[e] for e in stack[to:])
            del stack[to:]

        def closing(names: set, barriers: set) -> None:
            if not any(opened[name] for name in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in names:
                    close(i)
                    return
                if self.tag[stack[i]] in barriers:
                    return

        while at < len(source):
            found = tags.next(at)
            text = source[at : found[0] if found else len(source)]
            if not found:
                cut = text.rfind("<")
                text = text[:cut] if cut >= 0 and re.match(r"<[A-Za-z/!?]", text[cut : cut + 2]) else text
            if text:
                self.texts.append((self.block, stack[-1], text))
            if not found:
                break
            _, at, name, ending, attributes = found
            if not name:
                continue
            if ending:
                if not opened[name]:
                    self.block += name not in INLINE
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == name:
                        close(i)
                        break
                    # an inline end tag does not close the block around it
                    if name in INLINE and self.tag[stack[i]] not in INLINE:
                        break
                continue
            if name in RAW:
                behind = -1 if attributes.endswith("/") and name not in _OPAQUE else tags.after(name, at)
                at = behind if behind >= 0 else len(source) if name in _OPAQUE else at
                continue
            if name == "br":
                self.texts.append((self.block, stack[-1], " "))
                continue
            if name in CLOSES_P:
                closing({"p"}, {"td", "th", "li", "div", "article", "section", "main", "body", "blockquote"})
            if name in SIBLINGS:
                closing(*SIBLINGS[name])
            if name not in INLINE:
                self.block += 1
            if name in VOID:
                continue
            opened[name] += 1
            stack.append(self._opened(name, attributes, stack[-1]))

    def _opened(self, name: str, attributes: str, parent: int) -> int:
        import xxhash

        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        words = set(_WORD.findall(_HUMP.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower())) if found else set()
        kind = name
        if "class" in found:
            kind += "." + ".".join(sorted(re.sub(r"\d+", "#", found["class"]).split())[:3])
        whole = name in ("html", "body", "main")
        hard = (
            name in SKIPPED_TAGS
            or found.get("role", "").lower() in SKIPPED_ROLES
            or (name == "header" and not self.in_article[parent])
            or "hidden" in attributes.lower().split()
            or found.get("aria-hidden") == "true"
            or bool(_HIDDEN.search(found.get("style", "")))
        )
        commented = bool(words & COMMENT_WORDS) and not whole and not words & {"content", "main"}
        named = bool(words & CONTENT_WORDS)
        self.tag.append(name)
        self.parent.append(parent)
        self.kind.append(kind)
        # the path from the root as a hash, of one length at any depth
        self.path.append(xxhash.xxh64_intdigest(f"{self.path[parent]:x}/{kind}"))
        self.skip.append(self.skip[parent] or (hard and not whole))
        # comment words beside words of content do not settle what an element is, its share of the prose does
        self.soft.append((bool(words & SKIPPED_WORDS) or (commented and named)) and not whole)
        self.area.append("form" if name == "form" else "comments" if commented and not named else "")
        self.in_link.append(self.in_link[parent] or name == "a")
        self.in_article.append(self.in_article[parent] or name in ("article", "main"))
        return len(self.tag) - 1

    def _settle(self) -> None:
        """Skip forms and areas of comments, unless the article lies in them.

        One with a main title, article or main element inside is part of the page's
        frame, as is a form with most of the paragraphs outside comments, and any if nothing but such areas has text.
        """
        n = len(self.tag)
        holds, paragraphs, letters = [False] * n, [0] * n, [0] * n
        in_paragraph = [False] * n
        for e in range(1, n):
            in_paragraph[e] = in_paragraph[self.parent[e]] or self.tag[e] == "p"
        for _, e, text in self.texts:
            if not self.skip[e] and not self.in_link[e]:
                size = len(text.strip())
                letters[e] += size
                paragraphs[e] += size * in_paragraph[e]
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            holds[p] = holds[p] or holds[e] or (self.tag[e] in ("h1", "main") and not self.skip[e])
            if self.tag[e] == "article" and self.area[e] == "" and self.area[p] == "form":
                holds[p] = True
            paragraphs[p] += paragraphs[e]
            letters[p] += letters[e]
        areas = [e for e in range(1, n) if self.area[e] == "comments" and not holds[e]]
        commented, prose = [False] * n, paragraphs[0]
        for e in areas:
            commented[e] = True
        for e in range(1, n):
            prose -= paragraphs[e] * (commented[e] and not commented[self.parent[e]])
            commented[e] = commented[e] or commented[self.parent[e]]
        areas += [e for e in range(1, n) if self.area[e] == "form" and not holds[e] and paragraphs[e] <= 0.5 * prose]
        inside = [False] * n
        outer = 0
        for e in areas:
            inside[e] = True
        for e in range(1, n):
            if inside[e] and not inside[self.parent[e]]:
                outer += letters[e]
            inside[e] = inside[e] or inside[self.parent[e]]
        if letters[0] > outer:
            for e in range(1, n):
                self.skip[e] = self.skip[e] or inside[e]

    def _up(self, element: int) -> Iterator[int]:
        while element >= 0:
            yield element
            element = self.parent[element]

    def _weigh(self) -> None:
        n = len(self.tag)
        size, linked, items = [0] * n, [0] * n, [0] * n
        for _, element, text in self.texts:
            if self.skip[element]:
                continue
            letters = len(text.strip())
            size[element] += letters
            if self.in_link[element]:
                linked[element] += letters
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
            linked[self.parent[e]] += linked[e]
            items[self.parent[e]] += self.tag[e] == "li"
        whole = size[0]
        self.size, self.linked = size, linked
        for e in range(1, n):
            # a class that names furniture does not count on the element with most of the page's prose
            prose = size[e] - linked[e]
            furniture = self.soft[e] and not (self.tag[e] != "header" and prose > 0.6 * whole)
            menu = self.tag[e] in ("ul", "ol") and items[e] >= 3 and linked[e] > 0.8 * size[e]
            self.skip[e] = self.skip[e] or self.skip[self.parent[e]] or furniture or menu
        # the nearest container of each element, and the containers with unlinked prose or a title of their own
        self.home = [0] * n
        for e in range(1, n):
            self.home[e] = e if self.tag[e] in CONTAINERS else self.home[self.parent[e]]
        self.prose: set[int] = set()
        self.titled: set[int] = set()
        score = [0.0] * n
        own = [0] * n
        # the element itself, or the block around an inline one
        around = [0] * n
        for e in range(1, n):
            around[e] = around[self.parent[e]] if self.tag[e] in INLINE and self.parent[e] > 0 else e
        for _, element, text in self.texts:
            if self.skip[element]:
                continue
            e = element
            e = around[e]
            own[e] += 0 if self.in_link[element] else len(text.strip())
        for e in range(n):
            if not own[e]:
                continue
            holder = e if self.tag[e] in CONTAINERS or e == 0 else self.parent[e]
            self.prose.add(self.home[e])
            if self.tag[e] == "h1":
                self.titled.add(self.home[e])
            up, share = self.home[holder], 1.0
            while share >= 0.2:
                score[up] += share * own[e]
                share /= 2
                if up == 0:
                    break
                up = self.home[self.parent[up]]
        for e in range(n):
            if score[e]:
                score[e] *= 1.3 if self.tag[e] in ("article", "main") else 1.0
                if self._named_content(e):
                    score[e] *= 1.25
        self.score = score

    def _named_content(self, element: int) -> bool:
        return bool(set(_WORD.findall(self.kind[element])) & CONTENT_WORDS) and self.tag[element] not in ("body", "main", "article")

    def widened(self, chosen: set[int]) -> list[bool]:
        """Whether each element lies in the chosen containers or belongs to their article.

        An article around them counts whole; main, containers named as content and
        sections beside a section count without the other articles in them; any
        other ancestor gives the text that lies in it directly, and up to the body
        the text beside a title. Outside article and main the body does so too.
        """
        whole, lifted, direct = set(chosen), set(), set()
        above: set[int] = set()
        for c in chosen:
            for u in self._up(c):
                if u in above and u not in chosen:
                    break  # from here on as before
                above.add(u)
                outer = self.tag[u] in ("#page", "html", "body")
                if outer and self.in_article[c]:
                    break
                if self.tag[u] == "article":
                    whole.add(u)
                elif u != c and (self.tag[u] == "main" or (self._named_content(u) and not outer)):
                    lifted.add(u)
                elif u != c and u in self.prose:
                    direct.add(u)
        beside = {self.parent[u] for u in above if self.tag[u] == "section"}
        lifted |= {e for e, p in enumerate(self.parent) if p in beside and self.tag[e] == "section"}
        above = {u for u in above if self.tag[u] not in ("#page", "html", "body")}
        passed: set[int] = set()
        for t in self.titled:
            for u in self._up(t):
                if u in above:
                    direct.add(t)
                    break
                if self.tag[u] == "article" or u in passed:
                    break
                passed.add(u)
        n = len(self.tag)
        inside, wide = [False] * n, [False] * n
        for e in range(n):
            p = self.parent[e]
            inside[e] = e in whole or (e > 0 and inside[p])
            wide[e] = e in lifted or (e > 0 and wide[p] and self.tag[e] != "article")
        return [inside[e] or wide[e] or self.home[e] in direct for e in range(n)]

    def votes(self) -> dict[int, float]:
        """Share of the best score by generalised path."""
        best = max(self.score)
        out: dict[int, float] = {}
        for e, s in enumerate(self.score):
            if s > 0 and not self.skip[e]:
                out[self.path[e]] = max(out.get(self.path[e], 0.0), s / best)
        return out

    def text(self, path: int | None) -> str:
        """Blocks of the containers on `path`, or of the page's best container, and of their article."""
        chosen = {e for e, p in enumerate(self.path) if p == path and not self.skip[e] and self.score[e] > 0}
        if not chosen:
            best = max(range(len(self.score)), key=lambda e: self.score[e])
            chosen = {best} if self.score[best] > 0 else set()
        inside = self.widened(chosen) if chosen else [False] * len(self.tag)
        blocks: dict[int, list[str]] = {}
        for block, element, text in self.texts:
            if inside[element] and not self.skip[element]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, shares = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for path, share in Page(source.as_py() or "").votes().items():
                hosts.append(host)
                paths.append(path - 2**63)
                shares.append(share)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(shares, pa.float64())], names=["host", "path", "share"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source.as_py() or "").text(None if path is None else path + 2**63) for source, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: str):
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that wins the vote of the host's pages."""
    keyed = pages.select(host_of("url").alias("host"), "html").where("host <> ''")
    votes = keyed.mapInArrow(_voted, "host string, path bigint, share double")
    # shares in steps of 1e-6, so that sums do not depend on their order
    counted = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page, from the containers its host agrees on."""
    # a table of known size: small ones are broadcast, else Spark splits the pages of a hot host
    winners = stored(host_paths(pages)).withColumnRenamed("host", "_host")
    keyed = pages.select("page_id", "url", "html", host_of("url").alias("_own"))
    joined = keyed.join(winners, F.col("_own") == F.col("_host"), "left").select("page_id", "url", "html", "path")
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(_extracted, f"page_id {types['page_id']}, url {types['url']}, text string")
