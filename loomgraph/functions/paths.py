"""Paths and routes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_pathname(url: Column) -> Column:
    """The path of a URL or of an absolute path, without query and fragment; null for anything else. [PRV-04]"""
    plain = F.regexp_extract(url, r"^([^?#]*)", 1)
    absolute = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(url.startswith("/"), plain).when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.when(absolute == "", "/").otherwise(absolute))


def normalize_route(path: Column) -> Column:
    """Without query, fragment and trailing slashes; `/` for nothing. [PRV-18]"""
    cut = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def segment_to_route(segment: Column) -> Column:
    """[[...x]] and [...x] as :x*, [x] as :x. [PRV-17]"""
    out = F.regexp_replace(segment, r"^\[\[\.\.\.(.+)\]\]$", ":$1*")
    out = F.regexp_replace(out, r"^\[\.\.\.(.+)\]$", ":$1*")
    return F.regexp_replace(out, r"^\[(.+)\]$", ":$1")


def _joined(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, segment_to_route), "/"))


def route_for_file(path: Column) -> Column:
    """The route that a file serves by its place: app/**/page.* or pages/**; null for other files. [PRV-15]"""
    ext = r"\.(?:tsx|ts|jsx|js)$"
    app = F.regexp_extract(path, r"(?:^|/)app/(?:(.*)/)?page" + ext, 1)
    groups = F.filter(F.split(app, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))
    pages = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)pages/(.+)" + ext, 1), r"(^|/)index$", "$1")
    parts = F.filter(F.split(pages, "/"), lambda s: s != "")
    own = F.exists(parts, lambda s: s.startswith("_")) | path.rlike(r"(?:^|/)pages/api/")
    return F.when(path.rlike(r"(?:^|/)app/(?:.*/)?page" + ext), _joined(groups)).when(path.rlike(r"(?:^|/)pages/.+" + ext) & ~own, _joined(parts))


def api_route_for_file(path: Column) -> Column:
    """The endpoint that a file serves: app/**/route.* or pages/api/**; null for other files. [PRV-16]"""
    ext = r"\.(?:tsx|ts|jsx|js)$"
    app = F.regexp_extract(path, r"(?:^|/)app/(?:(.*)/)?route" + ext, 1)
    groups = F.filter(F.split(app, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))
    pages = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)pages/(api/.+)" + ext, 1), r"/index$", "")
    return F.when(path.rlike(r"(?:^|/)app/(?:.*/)?route" + ext), _joined(groups)).when(path.rlike(r"(?:^|/)pages/api/.+" + ext), _joined(F.filter(F.split(pages, "/"), lambda s: s != "")))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def same_shape(a: Column, b: Column) -> Column:
    """Whether two segment arrays agree, a segment that begins with a colon matching any. [FLT-11]"""
    agree = F.zip_with(a, b, lambda x, y: (x == y) | x.startswith(":") | y.startswith(":"))
    return (F.size(a) == F.size(b)) & F.forall(agree, lambda x: x)


def mermaid_id(id_: Column) -> Column:
    """[SCL-11]"""
    return F.concat(F.lit("n_"), F.regexp_replace(id_, "[^A-Za-z0-9]", "_"))


def escape_xml(text: Column) -> Column:
    """[SCL-16]"""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset. [PRV-43]"""
    return F.length(F.substring(text, F.lit(1), offset)) - F.length(F.replace(F.substring(text, F.lit(1), offset), F.lit("\n"), F.lit(""))) + 1


def iso_time(t: Column) -> Column:
    """[SCL-10]"""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
