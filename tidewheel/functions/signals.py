"""What a post is about: signal labels, hints, relevance rules, repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words, anywhere. The text is folded once, not again for each word."""
    return F.exists(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: _holds(low, [(w,) for w in words]))


def _holds(low: Column, sets: list[tuple[str, ...]]) -> Column:
    """Whether the text holds all words of one of the sets; plain search, no pattern."""
    tests = [reduce(Column.__and__, [low.contains(w) for w in words]) for words in sets]
    return reduce(Column.__or__, tests)


#: Words of which a match of each pattern in SIGNALS holds one set at least, in lower case.
_ANCHORS = [
    [("base", "url", "http"), ("api", "key"), *[(w, "ai") for w in ("venice", "opencode", "openrouter", "together", "groq", "fireworks")], ("deepseek",), ("qwen",), *[("free", a, b) for a in ("api", "llm", "model") for b in ("key", "access", "credit")]],
    [("free", "api", "credit"), ("$", " in ", "free"), ("$", "in", "free"), ("register", "get", "free"), ("openai", "compatible", "free"), ("no", "credit", "card"), ("day", "token"), ("day", "request"), ("daily", "reset", "free")],
    [("lifetime",), ("100", "%", "off"), ("1", "year"), ("one", "year"), ("appsumo",), ("saasmantra",), ("pitchground",), ("dealmirror",)],
    [("promo", "code"), ("promo", ":"), ("coupon",), ("use", "code"), ("%", "off"), ("1", "year", "free"), ("heygen", "trick"), ("lifetime",), ("appsumo",)],
    [*[(w, c) for w in ("promo", "coupon", "invite", "discount") for c in ":-"], ("use", "code"), ("use", "coupon"), ("code", ":")],
    [("open", "source"), ("replace",), ("github.com/",), ("show", "hn"), ("just", "launched"), ("today", "launched")],
    [("://github.com/",)],
    [(".edu.pk",), (".edu.bd",), ("ny", "ip"), ("free", "google"), ("gemini",), ("google", "one"), ("github", "student"), ("github", "education"), ("jetbrains",), ("figma",), ("student", "pack")],
]


def classify_signal(text: Column, low: Column | None = None) -> Column:
    """The first signal whose pattern the text holds; ``low``: the text in lower case, where it is at hand."""
    low = F.lower(text) if low is None else low
    label = F.lit(None).cast("string")
    for (name, pattern), words in reversed(list(zip(V.SIGNALS, _ANCHORS, strict=True))):
        label = F.when(_holds(low, words) & text.rlike(pattern), name).otherwise(label)
    return label


def has_deal_hint(text: Column, low: Column | None = None) -> Column:
    return has_any(text, V.DEAL_HINTS) if low is None else _holds(low, [(w,) for w in V.DEAL_HINTS])


def extract_github_repos(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.GITHUB_REPO), F.lit(0))


def promo_code_present(text: Column, low: Column | None = None) -> Column:
    return _holds(F.lower(text) if low is None else low, _ANCHORS[4]) & text.rlike(V.PROMO_CODE)


def promo_code(text: Column) -> Column:
    """The first code a promo pattern captures, or null."""
    return F.nullif(F.concat(*[F.regexp_extract(text, V.PROMO_CODE, i) for i in (1, 2, 3)]), F.lit(""))


def reddit_relevant(title: Column, body: Column, flair: Column) -> Column:
    blank = F.lit("")
    text = F.concat_ws(" ", F.coalesce(title, blank), F.coalesce(body, blank), F.coalesce(flair, blank))
    return has_any(text, V.REDDIT_KEYWORDS) | F.lower(F.coalesce(flair, blank)).isin(V.REDDIT_FLAIRS)


def devto_relevant(title: Column, description: Column, tags: Column, query_tag: Column) -> Column:
    blank = F.lit("")
    text = F.concat_ws(" ", F.coalesce(title, blank), F.coalesce(description, blank), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    return query_tag.isin(V.DEVTO_TAGS) | has_any(text, V.DEVTO_KEYWORDS)


def launch_relevant(title: Column, summary: Column) -> Column:
    return has_any(F.concat_ws(" ", title, summary), V.LAUNCH_KEYWORDS)


def repo_org(repo: Column, handle: Column) -> Column:
    """Owner of a repository URL or owner/name, else the author's handle; lower case."""
    tail = F.regexp_replace(F.trim(F.coalesce(repo, F.lit(""))), r"^(?s)(?:.*?github\.com/)", "")
    owner = F.get(F.filter(F.split(tail, "/"), lambda p: p != ""), 0)
    return F.lower(F.coalesce(owner, F.trim(F.coalesce(handle, F.lit("")))))


def diversity_tags(title: Column, repo: Column, handle: Column) -> Column:
    org = repo_org(repo, handle)
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(V.STOP_WORDS))
    return F.array_distinct(F.concat(F.when(org != "", F.array(F.concat(F.lit("org:"), org))).otherwise(F.array().cast("array<string>")), words))
