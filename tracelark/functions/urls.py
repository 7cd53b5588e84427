"""URL, path and address predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that make a search, hosts and paths of search engines, hosts that are examples,
# hosts and paths of private pages, query keys that carry secrets.
SEARCH_KEYS = ("q", "query", "keyword", "keywords", "wd", "text", "p")
SEARCH_PATHS = ("/search", "/web", "/s")
ENGINES = [
    (r"^google\.|\.google\.", ("/search", "/url", "/scholar")),
    (r"(^|\.)bing\.com$", ("/search",)),
    (r"(^|\.)baidu\.com$", ("/s", "/link")),
    (r"(^|\.)sogou\.com$", ("/web", "/link")),
    (r"(^|\.)so\.com$", ("/s", "/link")),
    (r"^search\.yahoo\.", ("/search",)),
    (r"(^|\.)duckduckgo\.com$", ("/", "/html", "/lite")),
    (r"^yandex\.|\.yandex\.", ("/search",)),
    (r"(^|\.)startpage\.com$", ("/sp/search",)),
    (r"^search\.brave\.com$", ("/search",)),
    (r"(^|\.)ecosia\.org$", ("/search",)),
]
EXAMPLE_HOSTS = ("example.com", "example.org", "example.net", "localhost", "127.0.0.1")
PRIVATE_PAGES = [
    ("doubao.com", "/thread/"),
    ("chatgpt.com", "/share/"),
    ("chat.openai.com", "/share/"),
    ("claude.ai", "/share/"),
    ("slack.com", "/archives/"),
    ("teams.microsoft.com", "/l/message/"),
    ("drive.google.com", "/"),
    ("docs.google.com", "/"),
    ("onedrive.live.com", "/"),
]
SECRET_KEYS = ("access_token", "auth", "authorization", "key", "secret", "sig", "signature", "token")

_AUTHORITY = r"^(?i)https?://([^/?#]*)"


def host(c: Column) -> Column:
    """Host of an address, lower case, without credentials, port and final dot; empty where there is none."""
    h = F.regexp_replace(F.regexp_extract(c, _AUTHORITY, 1), "^.*@", "")
    return F.lower(F.regexp_replace(h, r"(:\d*)?$|\.(?=:\d*$)", "")).alias("host")


def path(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^(?i)https?://[^/?#]*([^?#]*)", 1))


def query_keys(c: Column) -> Column:
    pairs = F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "&")
    return F.transform(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)))


def _any_of(keys: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(keys, F.array(*map(F.lit, names)))


def web_url(c: Column) -> Column:
    """Whether a text is an http(s) address: no blanks, control characters or broken escapes, no credentials, a port in
    range, and a host that is an IP literal or has two or more well-formed labels (letters of any script count)."""
    t = F.trim(c)
    label = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
    shape = rf"^https?://(?:{label}(?:\.{label})+\.?|\[[0-9a-fA-F:.]+\])(?::(\d{{1,5}}))?(?:[/?#].*)?$"
    port = F.regexp_extract(t, shape, 1)
    good_port = (port == "") | port.try_cast("int").between(1, 65535)
    return F.coalesce(t.rlike(shape) & good_port & ~t.rlike(r"[\x00-\x20\x7f]|%(?![0-9A-Fa-f]{2})"), F.lit(False))


def search_result(c: Column) -> Column:
    """Whether an address is a page of search results or a redirect of a search engine, and thus no source.

    Percent escapes of the path are decoded up to three times."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    p = path(c)
    for _ in range(3):
        p = F.coalesce(F.try_url_decode(F.regexp_replace(p, r"\+", "%2B")), p)
    p = F.regexp_replace(F.lower(p), "/+$", "")
    p = F.when(p == "", "/").otherwise(p)
    asks = _any_of(query_keys(c), SEARCH_KEYS)
    hit = p.isin(*SEARCH_PATHS) & asks
    for where, paths in ENGINES:
        hit = hit | (h.rlike(where) & p.isin(*paths))
    hit = hit | (h.rlike(r"(^|\.)bing\.com$") & p.startswith("/ck/")) | (h.rlike(r"(^|\.)qwant\.com$") & p.isin("/", "/search") & asks)
    hit = hit | (h.startswith("search.") & (p.isin("/", *SEARCH_PATHS) | asks))
    return web_url(c) & F.coalesce(hit, F.lit(False))


def suspicious_url(c: Column) -> Column:
    """Whether an address leads to a private page or carries a secret; example hosts never do, a missing host does."""
    h = host(c)
    private = F.lit(False)
    for name, prefix in PRIVATE_PAGES:
        private = private | (((h == name) | h.endswith("." + name)) & path(c).startswith(prefix))
    harmless = h.isin(*EXAMPLE_HOSTS) | h.endswith(".invalid")
    return F.when(h == "", True).when(harmless, False).otherwise(private | _any_of(query_keys(c), SECRET_KEYS))


def example_email(c: Column) -> Column:
    """Whether an e-mail address belongs to an example domain."""
    d = F.regexp_replace(F.lower(F.substring_index(c, "@", -1)), r"\.+$", "")
    return d.isin(*EXAMPLE_HOSTS) | d.endswith(".invalid")


def safe_relative_path(c: Column) -> Column:
    """Whether a path is relative, forward-slashed and never leaves its root."""
    steps = F.split(c, "/")
    return F.coalesce(c.rlike(r"^[^/\\:\x00][^\\:\x00]*$") & ~F.array_contains(steps, "..") & ~F.array_contains(steps, "."), F.lit(False))


def portable_id(c: Column) -> Column:
    """Whether a text is an opaque id: 1 to 128 ASCII letters, digits, dots, colons, dashes or underscores, no path."""
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z") & ~F.contains(c, F.lit("..")), F.lit(False))
