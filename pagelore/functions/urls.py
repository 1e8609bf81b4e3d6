"""URL handling as column expressions.

Three normal forms exist on purpose: they differ in what they keep (query,
port, parameters) and in whether foreign hosts are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.config import CrawlConfig
from pagelore.functions.arrays import let
from pagelore.functions.text import strip

# RFC 3986 appendix B, with a strict scheme.
_PARTS = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_CONTROL_AND_SPACE = "".join(chr(c) for c in range(0x21))


def url_parts(url: Column) -> Column:
    """Struct of scheme (lower case), netloc, path, query; absent parts are empty."""
    text = F.ltrim(F.coalesce(url, F.lit("")), F.lit(_CONTROL_AND_SPACE))
    text = F.translate(text, "\t\r\n", "")

    def cut(t: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(t, _PARTS, 1)).alias("scheme"),
            F.regexp_extract(t, _PARTS, 2).alias("netloc"),
            F.regexp_extract(t, _PARTS, 3).alias("path"),
            F.regexp_extract(t, _PARTS, 4).alias("query"),
        )

    return let(text, cut)


def _without_params(path: Column) -> Column:
    return F.regexp_replace(path, r";[^/]*$", "")


def _host_port(netloc: Column) -> Column:
    """Host and port without user info, e.g. ``[::1]:80`` or ``a.b:80``."""
    return F.substring_index(netloc, "@", -1)


def host_of(netloc: Column) -> Column:
    where = _host_port(netloc)
    bracketed = F.regexp_extract(where, r"^\[([^\]]*)", 1)
    return F.lower(
        F.when(where.startswith("["), bracketed).otherwise(F.substring_index(where, ":", 1))
    )


def port_of(netloc: Column) -> Column:
    return F.regexp_extract(_host_port(netloc), r"^(?:\[[^\]]*\]?|[^:]*):(.*)$", 1)


def _canonical_host(host: Column, cfg: CrawlConfig) -> Column:
    if not cfg.bare_host:
        return host
    return F.when(host == cfg.bare_host, F.lit(cfg.canonical_host)).otherwise(host)


def crawl_url(url: Column, cfg: CrawlConfig) -> Column:
    """Frontier form: https on the canonical host, query kept; otherwise empty."""

    def build(p: Column) -> Column:
        path = F.regexp_replace(_without_params(p["path"]), "/{2,}", "/")
        path = F.rtrim(path, F.lit("/"))
        host = _canonical_host(host_of(p["netloc"]), cfg)
        known = p["scheme"].isin("http", "https") & (host == cfg.canonical_host)
        return F.when(
            known,
            F.concat(
                F.lit(f"https://{cfg.canonical_host}"),
                F.when(path == "", F.lit("/")).otherwise(path),
                F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])),
            ),
        ).otherwise(F.lit(""))

    return let(url_parts(url), build)


def document_url(url: Column) -> Column:
    """Document form: any host, port and user info kept, query dropped."""

    def build(p: Column) -> Column:
        path = _without_params(p["path"])
        path = (
            F.when(path.isin("", "/"), F.lit("/"))
            .otherwise(F.rtrim(path, F.lit("/")))
        )
        return F.concat(p["scheme"], F.lit("://"), F.lower(p["netloc"]), path)

    empty = F.coalesce(url, F.lit("")) == ""
    return F.when(empty, F.lit("")).otherwise(let(url_parts(strip(url)), build))


def identity_url(url: Column, cfg: CrawlConfig | None = None) -> Column:
    """Identity form: default port and user info dropped, query and parameters kept.

    NULL where the port is not a number between 0 and 65535.
    """

    def build(p: Column) -> Column:
        host = host_of(p["netloc"])
        if cfg is not None:
            host = _canonical_host(host, cfg)
        port = port_of(p["netloc"])
        number = F.when(port.rlike(r"^[0-9]{1,9}$"), port.cast("int"))
        bad = (port != "") & (number.isNull() | (number > 65535))
        default = (
            (port == "")
            | (number == 0)
            | ((p["scheme"] == "https") & (number == 443))
            | ((p["scheme"] == "http") & (number == 80))
        )
        netloc = F.when(default, host).otherwise(
            F.concat(host, F.lit(":"), number.cast("string"))
        )
        path = F.when(p["path"].isin("", "/"), F.lit("/")).otherwise(
            F.rtrim(p["path"], F.lit("/"))
        )
        query = F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"]))
        scheme = F.when(p["scheme"] == "", F.lit("")).otherwise(F.concat(p["scheme"], F.lit(":")))
        slashes = (netloc != "") | (
            p["scheme"].isin("http", "https") & ((path == "") | path.startswith("/"))
        )
        return F.when(
            ~bad,
            F.concat(
                scheme, F.when(slashes, F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
                path, query,
            ),
        )

    return let(url_parts(strip(url)), build)


def is_crawlable(url: Column, cfg: CrawlConfig) -> Column:
    """https, the canonical (or bare) host, and no blocked file extension."""
    endings = "|".join(e.replace(".", r"\.") for e in cfg.blocked_extensions)

    def test(p: Column) -> Column:
        host = _canonical_host(host_of(p["netloc"]), cfg)
        path = F.lower(_without_params(p["path"]))
        return (
            (p["scheme"] == "https")
            & (host == cfg.canonical_host)
            & ~path.rlike(f"(?:{endings})$")
        )

    return let(url_parts(url), test)


def url_path(url: Column) -> Column:
    return _without_params(url_parts(url)["path"])


def _join_path(base_path: Column, path: Column) -> Column:
    """Merge a relative path with its base and remove dot segments."""
    folder = F.regexp_replace(base_path, r"[^/]+$", "")
    relative = F.concat(
        F.when(folder == "", F.lit("/")).otherwise(folder), path
    )
    # Empty segments inside a merged path vanish, an absolute path keeps its own.
    merged = F.when(path.startswith("/"), path).otherwise(
        F.regexp_replace(relative, r"/{2,}", "/")
    )

    def fold(full: Column) -> Column:
        segments = F.split(F.substring(full, 2, 1 << 30), "/")
        last_is_dot = full.rlike(r"/\.\.?$")
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
        return F.when(last_is_dot & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)

    return F.when(merged.rlike(r"(?:^|/)\.\.?(?:/|$)"), let(merged, fold)).otherwise(merged)


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` as seen from an http(s) page ``base`` (fragment dropped)."""

    def build(both: Column) -> Column:
        b, r = both["b"], both["r"]
        foreign = (r["scheme"] != "") & (r["scheme"] != b["scheme"])
        path = (
            F.when(r["netloc"] != "", r["path"])
            .when(r["path"] == "", b["path"])
            .otherwise(_join_path(b["path"], r["path"]))
        )
        query = F.when(
            (r["netloc"] == "") & (r["path"] == "") & (r["query"] == ""), b["query"]
        ).otherwise(r["query"])
        netloc = F.when(r["netloc"] != "", r["netloc"]).otherwise(b["netloc"])
        whole = F.concat(
            b["scheme"], F.lit("://"), netloc, path,
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        )
        return F.when(foreign, ref).otherwise(whole)

    return let(F.struct(url_parts(base).alias("b"), url_parts(ref).alias("r")), build)


def page_type(url: Column) -> Column:
    path = F.trim(F.lower(url_path(url)))
    path = F.btrim(path, F.lit("/"))
    return (
        F.when(path == "", "home")
        .when(path == "about", "about")
        .when(path.isin("career", "careers"), "career")
        .when(path == "case-studies", "case-studies")
        .when(path == "contact", "contact")
        .when(path == "services", "services")
        .when(path.startswith("services/"), "service")
        .otherwise("general")
    )
