"""Column functions over tagged conversation text. All are row-wise and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text (fixed values: that of Unicode).
BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
JOIN_THINKS = ";\n"
#: Heads a user turn into which several tool responses were merged (a fixed value).
SEVERAL_RESPONSES = "Previous tool call results:\n"
IMAGE = "<image>"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once per row, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tag_pattern(tag: str, group: str = "(.*?)") -> str:
    return f"(?s)<{tag}>{group}</{tag}>"


def tag_bodies(c: Column, tag: str) -> Column:
    """Stripped bodies of every well-formed pair of a tag, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(tag_pattern(tag)), F.lit(1)), strip)


def without_tags(c: Column, *tags: str) -> Column:
    for tag in tags:
        c = F.regexp_replace(c, tag_pattern(tag, ".*?"), "")
    return strip(c)


def thinks(c: Column) -> Column:
    """Thoughts of an assistant turn; calls and answers nested in them are taken out."""
    return F.transform(tag_bodies(c, "think"), lambda t: without_tags(t, "tool_call", "answer"))


def calls(c: Column) -> Column:
    return tag_bodies(c, "tool_call")


def answers(c: Column) -> Column:
    return tag_bodies(c, "answer")


def responses(c: Column) -> Column:
    """Tool responses of a user turn; without any, the whole text is one."""
    found = tag_bodies(c, "tool_response")
    return F.when(F.size(found) > 0, found).otherwise(F.array(strip(c)))


def _join(parts: Column, by: str) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), by)


def assistant_text(think: Column, call: Column, answer: Column) -> Column:
    """Canonical assistant turn; an answer outranks calls."""
    return F.concat(
        F.lit("<think>"),
        _join(think, JOIN_THINKS),
        F.lit("</think>"),
        F.when(F.size(answer) > 0, F.concat(F.lit("<answer>"), _join(answer, "\n"), F.lit("</answer>"))).otherwise(F.concat(F.lit("<tool_call>"), _join(call, "\n"), F.lit("</tool_call>"))),
    )


def user_text(parts: Column) -> Column:
    """Canonical user turn: one response, headed by a note if there were several."""
    kept = F.filter(parts, lambda x: x != "")
    return F.concat(F.lit("<tool_response>"), F.when(F.size(kept) >= 2, F.lit(SEVERAL_RESPONSES)).otherwise(""), F.array_join(kept, "\n"), F.lit("</tool_response>"))


def merge_assistant(a: Column, b: Column) -> Column:
    return assistant_text(F.concat(thinks(a), thinks(b)), F.concat(calls(a), calls(b)), F.concat(answers(a), answers(b)))


def merge_user(a: Column, b: Column) -> Column:
    return user_text(F.concat(responses(a), responses(b)))


def canonical_assistant(c: Column) -> Column:
    return assistant_text(thinks(c), calls(c), answers(c))


def canonical_user(c: Column) -> Column:
    return user_text(responses(c))


def answer_text(c: Column) -> Column:
    """Bodies of all answers by line; without any, the whole text."""
    found = answers(c)
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(c)


def think_text(c: Column) -> Column:
    """Thoughts by line; else what is before a closing tag, else after an opening one, else all."""
    found = tag_bodies(c, "think")
    before = F.substring_index(c, "</think>", 1)
    after_open = lambda x: F.substring(x, F.instr(x, "<think>") + 7, F.length(x))
    return (
        F.when(F.size(found) > 0, F.array_join(found, "\n"))
        .when(F.contains(c, F.lit("</think>")), strip(F.when(F.contains(before, F.lit("<think>")), after_open(before)).otherwise(before)))
        .when(F.contains(c, F.lit("<think>")), strip(after_open(c)))
        .otherwise(c)
    )


def first_tag(c: Column, tag: str) -> Column:
    """Stripped body of the first pair of a tag; null without one."""
    return F.get(tag_bodies(c, tag), F.lit(0))


def replace_think(c: Column, new: Column) -> Column:
    """The first thought replaced, or one put in front."""
    first = F.regexp_extract(c, tag_pattern("think", ".*?"), 0)
    at = F.position(first, c)
    block = F.concat(F.lit("<think>"), new, F.lit("</think>"))
    there = F.concat(F.substring(c, F.lit(1), at - 1), block, F.substring(c, at + F.length(first), F.length(c)))
    return F.when(first != "", there).otherwise(F.concat(block, F.lit("\n"), c))


def elide(c: Column, head: int = 900, tail: int = 200) -> Column:
    """A long text cut to its head and tail, with a note of what is missing; null as empty."""
    n = F.length(c)
    cut = F.concat(F.substring(c, 1, head), F.lit("\n...["), (n - head - tail).cast("string"), F.lit(" chars elided]...\n"), F.right(c, F.lit(tail)))
    return F.when(c.isNull(), "").when(n <= head + tail + 40, c).otherwise(cut)


def question_text(c: Column) -> Column:
    """What stands between the two markers of a question turn; without both, the whole text."""
    asked = strip(F.split(F.split(c, "Input Question:")[1], "Input image:")[0])
    return F.when(F.contains(c, F.lit("Input Question:")) & F.contains(c, F.lit("Input image:")), asked).otherwise(c)


def question_and_image(c: Column) -> Column:
    """(question, image) of a question turn; null unless both markers are there and both texts hold something."""
    rest = F.split(c, "Input Question:")[1]
    asked = F.struct(strip(F.split(rest, "Input image:")[0]).alias("question"), strip(F.split(rest, "Input image:")[1]).alias("image"))
    return F.when((asked["question"] != "") & (asked["image"] != ""), asked)


def question_of(messages: Column) -> Column:
    """The question of a conversation: what follows a system message, else what a user's first turn asks."""
    first = F.get(messages, F.lit(0))
    asked = strip(F.split(F.split(first["content"], "Input Question:")[1], "Input image: ")[0])
    return F.when(first["role"] == "system", F.get(messages, F.lit(1))["content"]).when(first["role"] == "user", asked)


def refilled(template: str, asked: Column) -> Column:
    """A prompt with ``{Question}`` and ``{ImageUrl}`` filled from (question, image)."""
    return F.replace(F.replace(F.lit(template), F.lit("{Question}"), asked["question"]), F.lit("{ImageUrl}"), asked["image"])


#: Phrases too common to need grounding (fixed values).
COMMON_PHRASES = ["New Zealand", "United States", "United Kingdom", "United Nations", "World War", "North America", "South America", "Middle East", "Far East"]
PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
YEAR = r"\b[0-9]{4}\b"
PERCENT = r"\b[0-9]+(?:\.[0-9]+)?%\b"


def grounding_tokens(c: Column) -> Column:
    """Phrases of capitalised words, years and percentages of a text, distinct."""
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in (PHRASE, YEAR, PERCENT)]
    return F.array_except(F.array_distinct(F.concat(*found)), F.array(*map(F.lit, COMMON_PHRASES)))


def count_images(c: Column) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(IMAGE), F.lit("")))) / len(IMAGE)).cast("int")


def clean_label(c: Column) -> Column:
    """A round's label without its decoration: the first token that is left."""
    for gone in ("Round ", "tool_call", "_"):
        c = F.replace(c, F.lit(gone), F.lit(""))
    return F.split(strip(c), " ")[0]


#: What a blocked or empty page says (fixed values).
BLOCKED = ["security verification", "captcha", "cloudflare", "access denied", "please verify", "robot", "enable javascript", "browser check", "cookies are required", "please enable cookies", "sign in to access", "institutional login", "subscribe to read", "purchase this article"]


def is_blocked(c: Column) -> Column:
    """Whether the head of a page says that it is blocked; so does an empty one."""
    low = F.lower(F.substring(c, 1, 2000))
    return F.coalesce(c == "", F.lit(True)) | F.coalesce(F.rlike(low, F.lit("|".join(BLOCKED))), F.lit(True))


#: Hosts of publishers whose pages need another route (fixed values).
PAYWALLED = [
    "www.sciencedirect.com", "linkinghub.elsevier.com", "onlinelibrary.wiley.com", "chemistry-europe.onlinelibrary.wiley.com",
    "advanced.onlinelibrary.wiley.com", "analyticalsciencejournals.onlinelibrary.wiley.com", "nph.onlinelibrary.wiley.com",
    "faseb.onlinelibrary.wiley.com", "link.aps.org", "journals.aps.org", "www.cell.com", "academic.oup.com", "www.tandfonline.com",
    "pubs.rsc.org", "www.rsc.org", "www.science.org", "www.jneurosci.org", "ashpublications.org", "pubs.aip.org",
    "journals.sagepub.com", "pubs.acs.org",
]


def route(url: Column) -> Column:
    """How a page is to be fetched, by its host."""
    host = F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    has = lambda *names: F.rlike(host, F.lit("|".join(n.replace(".", r"\.") for n in names)))
    return (
        F.when(has("pmc.ncbi.nlm.nih.gov"), "pmc")
        .when(has("pubmed.ncbi.nlm.nih.gov"), "pubmed")
        .when(has("biorxiv.org", "medrxiv.org"), "preprint")
        .when(host.isin(PAYWALLED), "paywalled")
        .otherwise("plain")
    )


#: Ids in URLs (fixed values).
PMC, PUBMED = "(PMC[0-9]+)", r"pubmed\.ncbi\.nlm\.nih\.gov/([0-9]+)"
DOI_RESOLVED, DOI_IN_PATH = r"doi\.org/(10\.[0-9]{4,}/[^\s]+)", r"/(10\.[0-9]{4,}/[^\s?#]+)"


def pmc_id(url: Column) -> Column:
    return F.regexp_extract(url, PMC, 1)


def pubmed_id(url: Column) -> Column:
    return F.regexp_extract(url, PUBMED, 1)


def doi(url: Column) -> Column:
    """DOI in a URL; of one behind the resolver's host all of the rest counts."""
    resolver = F.regexp_extract(url, DOI_RESOLVED, 1)
    path = F.regexp_extract(url, DOI_IN_PATH, 1)
    return F.regexp_replace(F.when(resolver != "", resolver).otherwise(path), "/+$", "")


def preprint_pdf(url: Column) -> Column:
    """Address of the PDF of a preprint's page; empty if there is none."""
    clean = F.regexp_replace(F.split(F.split(url, r"\?")[0], "#")[0], "/+$", "")
    ours = F.rlike(url, F.lit(r"biorxiv\.org|medrxiv\.org"))
    return F.when(ours & F.endswith(clean, F.lit(".pdf")), url).when(ours & F.contains(clean, F.lit("/content/")), F.concat(clean, F.lit(".full.pdf"))).otherwise("")


def judged_correct(c: Column, style: str = "qa") -> Column:
    """1 if a judge's reply says correct, else 0."""
    c = strip(c)
    hit = F.startswith(c, F.lit("A")) if style == "qa" else F.startswith(F.lower(c), F.lit("correct"))
    return F.coalesce(hit, F.lit(False)).cast("int")


def truncated(c: Column, limit: int = 20_000, note: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(note))).otherwise(c)


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def lenient_json(c: Column) -> Column:
    """JSON in a model's reply, as a VARIANT: the whole text, else a fenced block, else the
    outermost brackets, else braces; null if none is JSON."""
    text = strip(c)
    fenced = strip(F.regexp_extract(text, r"(?s)```(?:json|JSON)?\s*\n?(.*?)\n?```", 1))
    inner = F.when(F.rlike(text, F.lit(r"(?s)```(?:json|JSON)?\s*\n?(.*?)\n?```")), fenced).otherwise(text)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(fenced), *(F.try_parse_json(F.regexp_extract(inner, p, 0)) for p in (r"(?s)\[.*\]", r"(?s)\{.*\}")))


def has_cjk(c: Column) -> Column:
    """Whether a text has a character of the unified ideographs."""
    return F.rlike(c, F.lit("[一-鿿]"))


def asks_question(messages: Column) -> Column:
    """Whether the first message is a question in the expected form."""
    return F.coalesce(F.contains(F.get(messages, F.lit(0))["content"], F.lit("Input Question")), F.lit(False))


def renamed(messages: Column, names: dict[str, str]) -> Column:
    """Messages with strings of their contents replaced, one after the other."""

    def content(c: Column) -> Column:
        for old, new in names.items():
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), content(m["content"]).alias("content")))


#: Escapes of JSON strings (fixed values): those with a short form, and other control characters.
SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
CONTROLS = {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in SHORT_ESCAPES}


def json_string(c: Column) -> Column:
    """A text as a JSON string, with all but control characters as they are; null as null."""

    def replaced(c: Column, by: dict[str, str]) -> Column:
        for old, new in by.items():
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    short = replaced(c, SHORT_ESCAPES)
    whole = F.when(F.rlike(c, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]")), replaced(short, CONTROLS)).otherwise(short)
    return F.coalesce(F.concat(F.lit('"'), whole, F.lit('"')), F.lit("null"))


def message_json(messages: Column) -> Column:
    """Messages as one line of JSON: keys sorted, a space after each comma and colon, characters as they are."""
    one = lambda m: F.concat(F.lit('{"content": '), json_string(m["content"]), F.lit(', "role": '), json_string(m["role"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(messages, one), ", "), F.lit("]"))


def message_hash(messages: Column) -> Column:
    """Fingerprint of messages, the one that files carry: SHA-256 of their JSON."""
    return F.sha2(message_json(messages), 256)


def rendered_results(results: Column, top: int = 10, empty: str = "No results found.") -> Column:
    """Search results (title, url, snippet) as one text."""
    item = lambda r: F.concat(F.lit("Title: "), F.coalesce(r["title"], F.lit("")), F.lit("\nURL: "), F.coalesce(r["url"], F.lit("")), F.lit("\nSnippet: "), F.coalesce(r["snippet"], F.lit("")))
    return F.when(F.coalesce(F.size(results), F.lit(0)) > 0, F.array_join(F.transform(F.slice(results, 1, top), item), "\n\n---\n\n")).otherwise(empty)


def rendered_images(results: Column, top: int = 10, empty: str = "No image search results found.") -> Column:
    """Image search results (title, source, link, imageUrl) as one text."""
    fields = [("Title: ", "title"), ("\nSource: ", "source"), ("\nURL: ", "link"), ("\nImage: ", "imageUrl")]
    item = lambda r: F.concat(*(x for head, name in fields for x in (F.lit(head), F.coalesce(r[name], F.lit("")))))
    return F.when(F.coalesce(F.size(results), F.lit(0)) > 0, F.array_join(F.transform(F.slice(results, 1, top), item), "\n\n---\n\n")).otherwise(empty)


def cut_ids(ids: Column, cutoff: int = 2048, packing: bool = False) -> Column:
    """Token ids up to the cutoff; packing keeps one place free."""
    return F.slice(ids, 1, cutoff - 1 if packing else cutoff)


def label_mask(roles: Column, train_on_prompt: bool = False, mask_history: bool = False) -> Column:
    """Which turns are trained on: the assistant's, only the last of them, or all. The two options exclude each other."""
    if train_on_prompt and mask_history:
        raise ValueError("train_on_prompt and mask_history exclude each other")
    if train_on_prompt:
        return F.transform(roles, lambda _: F.lit(True))
    last = F.size(roles) - F.array_position(F.reverse(roles), F.lit("assistant"))
    return F.transform(roles, lambda r, i: (r == "assistant") & ((i == last) if mask_history else F.lit(True)))
