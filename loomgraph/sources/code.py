"""Providers over source trees: files are scanned for positioned matches, and all else is joins and windows over these.

TypeScript and JavaScript are matched by regular expressions. Dart, Kotlin, Java, Swift and Objective-C are cut into tokens, of
which a scanner of brackets makes facts of syntax (calls with their arguments, assignments, classes, map entries, labels); what
a fact means is a condition on its columns. Neither is a parser of a language, so what a type checker would resolve (re-exports,
computed names, generics, strings put together) is not seen.
"""

from __future__ import annotations

import posixpath
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.paths import api_route_for_file, normalize_route, route_for_file, to_pathname
from loomgraph.operators.merge import dedup_edges, merge_nodes, normalize_roles, repair
from loomgraph.schema import EDGES, NODES, Graph, complete
from loomgraph.scratch import Scratch, ship
from loomgraph.sources.pages import canonical_routes

#: Folders that are skipped, and extensions.
SKIPPED = ("node_modules", "dist", "build", "out", "coverage")
EXTENSIONS = {"frontend": r"\.(?:ts|tsx|js|jsx)$", "nestjs": r"\.ts$", "dart": r"\.dart$", "native": r"\.(?:kt|java|swift|m|mm)$"}
NOT_READ = {"frontend": r"\.d\.ts$|\.(?:test|spec)\.\w+$", "nestjs": r"\.d\.ts$|\.(?:test|spec)\.ts$", "dart": r"\.(?:g|freezed)\.dart$", "native": r"(?!)"}
ORDER = ("frontend", "nestjs", "dart", "native")

#: What each provider looks for. Groups 1 and 2 are kept.
RULES = {
    "frontend": {
        "import": r"""\bimport\s+(?:type\s+)?([^'";]+?)\s+from\s+['"]([^'"]+)['"]""",
        "component": r"(?m)^(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function|const|let|class)\s+([A-Z]\w*)\s*(?:[:=(<]|extends)",
        "hook": r"(?m)^(?:export\s+(?:default\s+)?)?(?:function|const)\s+(use[A-Z]\w*)\s*[:=(<]",
        "context": r"(?m)^(?:export\s+)?const\s+([A-Z]\w*)\s*(?::[^=]+)?=\s*(?:React\.)?createContext\b",
        "default": r"\bexport\s+default\s+(?:async\s+)?(?:function\s+|class\s+)?([A-Za-z_]\w*)",
        "tag": r"<([A-Z]\w*)(?:\.\w+)*[\s/>]",
        "jsx": r"<(>|[A-Za-z][\w.]*[\s/>])",
        "link": r"""<Link\b[^>]*?\bhref=(?:\{\s*)?['"`]([^'"`]+)['"`]""",
        "use": r"\b(use[A-Z]\w*)\s*(?:<[^>()]*>)?\(\s*([A-Z]\w*)?",
        "navigate": r"""(?:(?:\.|\b)(?:push|replace)|\bredirect|\bnavigate)\(\s*['"`]([^'"`]+)['"`]""",
        "fetch": r"""\bfetch\(\s*['"`]([^'"`]+)['"`](?:\s*,\s*\{[^}]*?\bmethod:\s*['"](\w+)['"])?""",
        "client": r"""\b\w*(?:axios|api|client|http)\w*\.(get|post|put|patch|delete)\s*(?:<[^>()]*>)?\(\s*['"`]([^'"`]+)['"`]""",
    },
    "nestjs": {
        "prefix": r"""\bsetGlobalPrefix\(\s*['"]([^'"]*)['"]""",
        "class": r"""@(Controller|Injectable|Module|Entity|Table)\s*\((?:[^()]|\([^()]*\))*\)\s*(?:@\w+\s*\([^()]*\)\s*)*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)""",
        "base": r"""@Controller\s*\(\s*(?:\{[^}]*?path:\s*)?['"]([^'"]*)['"]""",
        "method": r"""@(Get|Post|Put|Patch|Delete|Options|Head|All)\s*\(\s*(?:['"]([^'"]*)['"])?""",
        "inject": r"(?:private|public|protected|readonly)\s+(?:readonly\s+)?(\w+)\s*:\s*([A-Z]\w*)",
        "repository": r"@Inject(?:Model|Repository)\s*\(\s*([A-Z]\w*)",
        "wired": r"\b(controllers|providers|imports)\s*:\s*\[([^\]]*)\]",
    },
}
WIDGETS = ("StatelessWidget", "StatefulWidget", "ConsumerWidget", "ConsumerStatefulWidget", "HookWidget", "HookConsumerWidget")
CONTAINERS = ("ChangeNotifier", "StateNotifier", "Cubit", "Bloc", "Notifier", "AsyncNotifier", "GetxController")
HITS = "path string, rule string, offset int, line int, a string, b string"
#: Classes of platform channels, and Dart functions that move to a path.
CHANNELS = ("MethodChannel", "EventChannel", "BasicMessageChannel")
NAMED_MOVES, PATH_MOVES = ("pushNamed", "pushNamedAndRemoveUntil"), ("context.go", "context.push", "context.pushReplacement", "context.replace", "Get.toNamed", "Get.offNamed")
HTTP_METHODS, HTTP_CLIENTS = ("get", "post", "put", "patch", "delete"), ("http", "dio", "client", "api")
FACTS = "path string, fact string, offset int, line int, name string, of string, args array<struct<label:string,text:string,makes:string>>"
#: An argument of more tokens than this is told by its first.
TOLD = 8
#: Files that a task matches, and fewer than which are no task of their own.
FILES_A_TASK, FEW_FILES = 2048, 64

_COMMENT = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?(?:\*/|$)""", re.S)


def strip_comments(text: str) -> str:
    """Without comments outside strings; every line stays where it is. [PRV-35]"""
    return _COMMENT.sub(lambda m: m[0] if m[1] else re.sub(r"[^\n]", " ", m[0]), text)


def is_source(path: Column) -> Column:
    """Whether no part of a path is a dot entry or a folder that is skipped. [SRC-01, SRC-02]"""
    return ~path.rlike(r"(?:^|/)\.|(?:^|/)(?:" + "|".join(SKIPPED) + ")/")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), hash and content of the text files under root, but for dot entries and build folders. [SRC-01, SRC-02]"""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx,js,jsx,dart,kt,java,swift,m,mm,yaml}").load(root)
    base = posixpath.normpath(re.sub(r"^[a-z]+:(?://[^/]*)?", "", root))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", ""), "^/*" + re.escape(base.lstrip("/")) + "/", "")
    rows = raw.select(path.alias("path"), F.sha1("content").alias("hash"), F.decode("content", "UTF-8").alias("content"))
    return rows.where(is_source(F.col("path")))


def files_of(files: DataFrame, provider: str, most: int | None = None) -> DataFrame:
    """The provider's files; with `most` the first so many in path order, and a warning of how many are left out. [SRC-03..06]"""
    rows = files.where(F.col("path").rlike(EXTENSIONS[provider]) & ~F.col("path").rlike(NOT_READ[provider]))
    if provider == "native":
        rows = rows.where(F.col("path").rlike("^(?:android|ios)/"))
    if provider == "nestjs":
        rows = rows.where(F.col("content").rlike(r"@(?:Controller|Injectable|Module|Entity|Table)\b|setGlobalPrefix"))
    if most is not None and (over := rows.count() - most) > 0:
        warnings.warn(f"{provider}: {over} files beyond the first {most} are not read", stacklevel=2)
        rows = rows.orderBy("path").limit(most)
    return rows


def dealt(files: DataFrame) -> DataFrame:
    """Path and content of the files, dealt to tasks of about FILES_A_TASK of them, or to all cores if there are fewer.

    Alike sources are small as tables, so by its bytes Spark would have many thousands of them read, and matched, in one task.
    """
    n, cores = files.count(), files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content").repartition(max(1, -(-n // FILES_A_TASK), min(cores, n // FEW_FILES)), "path")


def scan(files: DataFrame, provider: str) -> DataFrame:
    """path, rule, offset, line, a and b of every match. [PRV-01, PRV-43]"""
    rules = {k: re.compile(v) for k, v in RULES[provider].items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text = strip_comments(content or "")
                for rule, pattern in rules.items():
                    for m in pattern.finditer(text):
                        out.append((path, rule, m.start(), text.count("\n", 0, m.start()) + 1, m[1], m[2] if pattern.groups > 1 else None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "rule", "offset", "line", "a", "b"])

    ship(files.sparkSession)
    return dealt(files).mapInArrow(run, HITS)


_LEXEME = re.compile(r"""@?"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*|\d[\w.]*|=>|\S""")
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def _is_name(token: str) -> bool:
    return token[0].isalpha() or token[0] == "_"


def _is_text(token: str) -> bool:
    return token[0] in "'\"" or token.startswith('@"')


class Tokens:
    """A text's tokens with their offsets and where each bracket's partner is."""

    def __init__(self, text: str):
        found = [(m[0], m.start()) for m in _LEXEME.finditer(text)]
        self.words, self.offsets = [w for w, _ in found], [o for _, o in found]
        self.partner: dict[int, int] = {}
        opened: list[int] = []
        for i, w in enumerate(self.words):
            if w in _CLOSE:
                opened.append(i)
            elif opened and w == _CLOSE[self.words[opened[-1]]]:
                self.partner[opened.pop()] = i

    def chain_before(self, i: int) -> int:
        """Where the dotted name begins that ends before token i; i itself if there is none."""
        at = i
        while at and _is_name(self.words[at - 1]):
            at -= 1
            if at < 2 or self.words[at - 1] != "." or not _is_name(self.words[at - 2]):
                break
            at -= 1
        return at

    def typed_before(self, i: int) -> int:
        """Where the <...> begins that ends before token i; i itself if there is none."""
        if not i or self.words[i - 1] != ">":
            return i
        depth, at = 0, i - 1
        while at >= 0 and (self.words[at] in ("<", ">", ",", ".", "?") or _is_name(self.words[at])):
            depth += (self.words[at] == ">") - (self.words[at] == "<")
            if not depth:
                return at
            at -= 1
        return i

    def makes(self, start: int, stop: int) -> str | None:
        """The first capitalised name in a span that is called."""
        for i in range(start, stop - 1):
            if self.words[i][0].isupper() and self.words[i + 1] == "(":
                return self.words[i]
        return None

    def arguments(self, opening: int) -> list[tuple[str | None, str, str | None]]:
        """(label, text, made) of the arguments between a bracket and its partner."""
        out, start, i = [], opening + 1, opening + 1
        end = self.partner.get(opening, opening)
        while i <= end:
            if i == end or self.words[i] == ",":
                if i > start:
                    label = self.words[start] if i > start + 2 and self.words[start + 1] == ":" and _is_name(self.words[start]) else None
                    first = start + 2 if label else start
                    span = self.words[first:i] if i - first <= TOLD else self.words[first : first + 1]
                    out.append((label, "".join(span), self.makes(first, i) if label else None))
                start = i + 1
            i = self.partner.get(i, i) + 1
        return out

    def facts(self) -> Iterator[tuple[str, int, str, str | None, list]]:
        """(fact, offset, name, of, arguments): calls, classes and what they extend, assigned texts and calls, entries of maps, labels."""
        w = self.words
        for i, word in enumerate(w):
            after = w[i + 1] if i + 1 < len(w) else ""
            if word == "(" and i in self.partner:
                generic = self.typed_before(i)
                start = self.chain_before(generic)
                if start < generic:
                    yield "call", self.offsets[start], "".join(w[start:generic]), "".join(w[generic + 1 : i - 1]) or None, self.arguments(i)
            elif word == "class" and _is_name(after or "0"):
                if i + 3 < len(w) and w[i + 2] == "extends":
                    inner = w[i + 5] if i + 5 < len(w) and w[i + 4] == "<" else None
                    yield "class", self.offsets[i], after, w[i + 3], [(None, inner, None)] if inner else []
            elif word == "=" and after:
                name = i - 3 if i > 2 and w[i - 2] == ":" and _is_name(w[i - 1]) and _is_name(w[i - 3]) else i - 1
                if name >= 0 and _is_name(w[name]):
                    if _is_text(after):
                        yield "constant", self.offsets[name], w[name], after, []
                    elif _is_name(after):
                        stop = i + 2
                        while stop + 1 < len(w) and w[stop] == "." and _is_name(w[stop + 1]):
                            stop += 2
                        yield "made", self.offsets[name], w[name], "".join(w[i + 1 : stop]), []
            elif word == ":" and i and after:
                if _is_text(w[i - 1]) and after == "(" and i + 1 in self.partner:
                    body = self.partner[i + 1] + 1
                    if body < len(w) and w[body] == "=>":
                        yield "entry", self.offsets[i - 1], w[i - 1], self.makes(body, min(len(w), body + 4)), []
                elif _is_name(w[i - 1]):
                    yield "label", self.offsets[i - 1], w[i - 1], after, []
            elif word == "import" and _is_text(after or "0"):
                yield "import", self.offsets[i], after, None, []


def facts(files: DataFrame) -> DataFrame:
    """path, fact, offset, line, name, of and args of every fact of syntax. [PRV-01, PRV-43]"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("fact", pa.string()), ("offset", pa.int32()), ("line", pa.int32()), ("name", pa.string()), ("of", pa.string()), ("args", pa.list_(pa.struct([("label", pa.string()), ("text", pa.string()), ("makes", pa.string())])))])
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text = strip_comments(content or "")
                ends = [m.start() for m in re.finditer("\n", text)]
                for fact, offset, name, of, args in Tokens(text).facts():
                    told = [{"label": a, "text": b, "makes": c} for a, b, c in args]
                    out.append({"path": path, "fact": fact, "offset": offset, "line": bisect_left(ends, offset) + 1, "name": name, "of": of, "args": told})
            yield pa.RecordBatch.from_pylist(out, schema)

    ship(files.sparkSession)
    return dealt(files).mapInArrow(run, FACTS)


def literal(token: Column) -> Column:
    """A string token's text; null for another token."""
    text = F.regexp_extract(token, r"""^@?["'](.*)["']$""", 1)
    return F.when(text != "", text)


def argument(label: str) -> Column:
    """The first argument of a label; null without one."""
    return F.get(F.filter("args", lambda x: x["label"] == label), F.lit(0))


def first_literal(most: int) -> Column:
    """The first string among the first `most` arguments without a label, within a call around it too."""
    plain = F.slice(F.filter("args", lambda x: x["label"].isNull()), 1, most)
    texts = F.transform(plain, lambda x: F.regexp_extract(x["text"], r"""^(?:[\w.]+\()?["']([^"']+)["']""", 1))
    return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))


def last_part(column: str = "name") -> Column:
    return F.element_at(F.split(column, r"\."), -1)


def _written(df: DataFrame) -> DataFrame:
    """A table that many joins read is computed once."""
    return Scratch(df.sparkSession, "code").save(df)


def _hits(hits: DataFrame, *rules: str) -> DataFrame:
    return hits.where(F.col("rule").isin(*rules))


def _base(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def owned(hits: DataFrame, declared: DataFrame) -> DataFrame:
    """Adds owner: of the declarations (path, offset, owner) of the file the last at or before the match, else the file. [PRV-24, PRV-38, JON-11, JON-12, WIN-06]"""
    both = hits.withColumn("owner", F.lit(None).cast("string")).withColumn("is_hit", F.lit(1)).unionByName(declared.select("path", "offset", "owner", F.lit(0).alias("is_hit")), allowMissingColumns=True)
    upto = Window.partitionBy("path").orderBy("offset", "is_hit").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("owner", F.coalesce(F.last("owner", ignorenulls=True).over(upto), "path")).where("is_hit = 1").drop("is_hit")


def _edge(rows: DataFrame, src: Column, dst: Column, kind: str, confidence: Column | None = None) -> DataFrame:
    place = F.struct(F.col("path").alias("file"), F.col("line").cast("int").alias("line"))
    return complete(rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), place.alias("source"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence")), EDGES)


def _node(rows: DataFrame, kind: str, **columns) -> DataFrame:
    return complete(rows.select(*[v.alias(k) for k, v in columns.items()], F.lit(kind).alias("type")), NODES).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def resolve_path(base: str = "path", target: str = "b") -> Column:
    """A relative import's path without extension, `.` and `..` folded; null for packages. [PRV-39]"""
    parts = F.concat(F.slice(F.split(base, "/"), F.lit(1), F.greatest(F.size(F.split(base, "/")) - 1, F.lit(0))), F.split(target, "/"))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(F.col(target).startswith("."), F.array_join(folded, "/"))


def frontend(files: DataFrame) -> Graph:
    """Components, hooks, contexts, routes and endpoints of TypeScript and JavaScript. [PRV-13, PRV-15..PRV-29]"""
    own = files_of(files, "frontend")
    hits = _written(scan(own, "frontend"))
    declared = _hits(hits, "component", "hook", "context").select("path", "rule", "offset", "line", F.col("a").alias("name"), F.concat("path", F.lit("#"), "a").alias("owner"))
    first = Window.partitionBy("owner").orderBy(F.when(F.col("rule") == "context", 0).otherwise(1), "offset")
    declared = declared.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    declared = declared.withColumn("next", F.lead("line").over(Window.partitionBy("path").orderBy("offset")))
    size = own.select("path", (F.size(F.split("content", "\n")) + 1).alias("lines"))
    declared = declared.join(size, "path").withColumn("loc", F.coalesce("next", "lines") - F.col("line"))
    default = _hits(hits, "default").groupBy("path").agg(F.min_by("a", "offset").alias("default"))
    # a capitalised function is a component only if it holds an element
    drawn = owned(_hits(hits, "jsx"), declared).select("owner").distinct()
    declared = declared.where("rule <> 'component'").unionByName(declared.where("rule = 'component'").join(drawn, "owner", "left_semi").select(declared.columns))
    declared = _written(declared.join(default, "path", "left").withColumn("is_default", F.coalesce(F.col("name") == F.col("default"), F.lit(False))))

    imports = _hits(hits, "import").select("path", "line", "a", resolve_path().alias("stem")).where(F.col("stem").isNotNull())
    stems = own.select(F.col("path").alias("target"), F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/index$", "").alias("stem"))
    stems = stems.groupBy("stem").agg(F.min("target").alias("target"))
    imports = imports.join(stems, "stem")
    plain = F.regexp_replace("a", r"\{[^}]*\}|\*\s+as\s+\w+|,", " ")
    inner = F.filter(F.split(F.regexp_extract("a", r"\{([^}]*)\}", 1), r"\s*,\s*"), lambda x: F.trim(x) != "")
    local = F.transform(inner, lambda x: F.struct(F.element_at(F.split(F.trim(x), r"\s+as\s+"), -1).alias("local"), F.element_at(F.split(F.trim(x), r"\s+as\s+"), 1).alias("name")))
    bound = imports.select("path", "target", F.explode(F.concat(local, F.when(F.trim(plain) != "", F.array(F.struct(F.trim(plain).alias("local"), F.lit("default").alias("name")))).otherwise(F.array().cast("array<struct<local:string,name:string>>")))).alias("i")).select("path", "target", "i.*")
    symbols = declared.select(F.col("path").alias("target"), "name", F.col("owner").alias("id"), "rule").unionByName(declared.where("is_default").select(F.col("path").alias("target"), F.lit("default").alias("name"), F.col("owner").alias("id"), "rule"))
    seen = bound.join(symbols, ["target", "name"]).select("path", "local", F.col("id").alias("imported"), F.col("rule").alias("r1"))
    here = declared.select("path", F.col("name").alias("local"), F.col("owner").alias("own_id"), F.col("rule").alias("r2"))

    refs = _written(owned(_hits(hits, "tag", "link", "use", "navigate", "fetch", "client"), declared))

    def resolved(rows: DataFrame, name: str) -> DataFrame:
        out = rows.withColumn("local", F.col(name)).join(seen, ["path", "local"], "left").join(here, ["path", "local"], "left")
        return out.withColumn("to", F.coalesce("imported", "own_id")).withColumn("to_rule", F.coalesce("r1", "r2")).where(F.col("to").isNotNull() & (F.col("to") != F.col("owner")))

    tags = resolved(_hits(refs, "tag"), "a").where("to_rule = 'component'")
    hooks = resolved(_hits(refs, "use").where("a <> 'useContext'"), "a").where("to_rule = 'hook'")
    contexts = resolved(_hits(refs, "use").where("a = 'useContext' AND b IS NOT NULL"), "b").where("to_rule = 'context'")
    routes = own.select("path", route_for_file(F.col("path")).alias("route")).where("route IS NOT NULL")
    served = own.select("path", api_route_for_file(F.col("path")).alias("route")).where("route IS NOT NULL")
    shows = routes.join(declared.where("is_default").select("path", F.col("owner").alias("page")), "path", "left").withColumn("line", F.lit(1))
    template = lambda c: F.regexp_replace(c, r"\$\{[^}]*\}", ":param")
    moves = _hits(refs, "link", "navigate").withColumn("target", normalize_route(to_pathname(template("a")))).where("target IS NOT NULL")
    moves = moves.join(canonical_routes(moves.select("target"), routes), "target")
    calls = _hits(refs, "fetch").withColumns({"method": F.upper(F.coalesce("b", F.lit("GET"))), "url": template("a")}).unionByName(_hits(refs, "client").withColumns({"method": F.upper("a"), "url": template("b")}))
    calls = calls.withColumn("url", to_pathname(F.col("url"))).where("url IS NOT NULL").withColumn("api", F.concat("method", F.lit(" "), "url"))
    nodes = [
        _node(own, "file", id=F.col("path"), name=_base(), file=F.col("path")),
        *[_node(declared.where(F.col("rule") == k), k, id=F.col("owner"), name=F.col("name"), file=F.col("path"), loc=F.col("loc"), is_default_export=F.col("is_default")) for k in ("component", "hook", "context")],
        _node(routes, "route", id=F.concat(F.lit("route:"), "route"), name=F.col("route"), file=F.col("path")),
        _node(served, "api", id=F.concat(F.lit("api:ROUTE "), "route"), name=F.col("route"), file=F.col("path"), declared=F.lit(True)),
        _node(calls, "api", id=F.concat(F.lit("api:"), "api"), name=F.col("api")),
        _node(moves, "route", id=F.concat(F.lit("route:"), "route"), name=F.col("route")),
    ]
    edges = [
        _edge(declared, F.col("path"), F.col("owner"), "defines"),
        _edge(imports, F.col("path"), F.col("target"), "imports"),
        _edge(shows, F.concat(F.lit("route:"), "route"), F.coalesce("page", "path"), "routes_to"),
        _edge(tags, F.col("owner"), F.col("to"), "renders"),
        _edge(hooks.unionByName(contexts), F.col("owner"), F.col("to"), "uses"),
        _edge(moves, F.col("owner"), F.concat(F.lit("route:"), "route"), "navigates_to", F.when(F.col("confidence") < 1, F.col("confidence"))),
        _edge(calls, F.col("owner"), F.concat(F.lit("api:"), "api"), "calls"),
    ]
    return Graph(_union(nodes), _union(edges))


def join_route(*parts: Column) -> Column:
    """[PRV-34, SCL-02]"""
    segments = F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def nestjs(files: DataFrame) -> Graph:
    """Controllers, services, modules and entities with their routes, injections and wiring. [PRV-30..PRV-34]"""
    own = files_of(files, "nestjs")
    hits = _written(scan(own, "nestjs"))
    kinds = F.create_map(*[F.lit(x) for p in (("Controller", "controller"), ("Injectable", "service"), ("Module", "module"), ("Entity", "entity"), ("Table", "entity")) for x in p])
    classes = _hits(hits, "class").select("path", "offset", "line", F.col("b").alias("name"), kinds[F.col("a")].alias("kind"), F.concat("path", F.lit("#"), "b").alias("owner"))
    by_name = classes.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("path", "offset"))).where("k = 1").select("name", F.col("owner").alias("to"), F.col("kind").alias("to_kind"))
    prefix = _hits(hits, "prefix").agg(F.coalesce(F.max_by("a", F.struct("path", "offset")), F.lit("")).alias("prefix"))
    refs = owned(_hits(hits, "base", "method", "inject", "repository", "wired"), classes)
    bases = _hits(refs, "base").groupBy("owner").agg(F.min_by("a", "offset").alias("base"))
    methods = _hits(refs, "method").join(classes.where("kind = 'controller'").select("owner"), "owner", "left_semi").join(bases, "owner", "left").join(F.broadcast(prefix))
    methods = methods.withColumn("name", F.concat(F.upper("a"), F.lit(" "), join_route(F.col("prefix"), F.coalesce("base", F.lit("")), F.coalesce("b", F.lit("")))))
    inject = _hits(refs, "inject").withColumn("name", F.col("b")).join(by_name, "name").where(F.col("owner") != F.col("to"))
    repository = _hits(refs, "repository").withColumn("name", F.col("a")).join(by_name, "name")
    wired = _hits(refs, "wired").select("path", "line", "owner", F.col("a").alias("what"), F.explode(F.regexp_extract_all(F.regexp_replace("b", r"\.\w+\([^)]*\)", ""), F.lit(r"\b([A-Z]\w*)"), F.lit(1))).alias("name")).join(by_name, "name")
    nodes = [_node(classes.where(F.col("kind") == k), k, id=F.col("owner"), name=F.col("name"), file=F.col("path"), framework=F.lit("nestjs")) for k in ("controller", "service", "module", "entity")]
    nodes.append(_node(methods, "api", id=F.concat(F.lit("api:"), "name"), name=F.col("name"), file=F.col("path"), declared=F.lit(True), framework=F.lit("nestjs")))
    edges = [
        _edge(methods, F.concat(F.lit("api:"), "name"), F.col("owner"), "routes_to"),
        _edge(inject.where("to_kind <> 'entity'"), F.col("owner"), F.col("to"), "injects"),
        _edge(inject.where("to_kind = 'entity'").select("path", "line", "owner", "to").unionByName(repository.select("path", "line", "owner", "to")), F.col("owner"), F.col("to"), "uses"),
        _edge(wired.where("what <> 'imports'"), F.col("owner"), F.col("to"), "contains"),
        _edge(wired.where("what = 'imports'"), F.col("owner"), F.col("to"), "imports"),
    ]
    return Graph(_union(nodes), _union(edges))


def _channel_names(rows: DataFrame, constants: DataFrame) -> DataFrame:
    """Adds channel: the token `text` as a literal, or the file's first constant of that identifier. [PRV-40, PRV-42]"""
    ident = F.when(F.col("text").rlike(r"^[\w.]+$"), last_part("text"))
    known = constants.groupBy("path", F.col("name").alias("ident")).agg(F.min_by(literal(F.col("of")), "offset").alias("value"))
    out = rows.withColumns({"literal": literal(F.col("text")), "ident": ident}).join(known, ["path", "ident"], "left")
    return out.withColumn("channel", F.coalesce("literal", "value")).where("channel IS NOT NULL")


def native(files: DataFrame) -> Graph:
    """Platform channels that Android and iOS code handles: constructed with a messenger and a name, or named by a label. [PRV-41, PRV-42]"""
    found = _written(facts(files_of(files, "native")))
    made = found.where(F.col("fact") == "call").withColumn("class", last_part())
    jvm = made.where(F.col("class").isin(*CHANNELS)).withColumn("text", F.get(F.col("args"), F.lit(1))["text"])
    swift = made.where(F.col("class").isin(*[f"Flutter{c}" for c in CHANNELS])).withColumn("text", argument("name")["text"])
    labels = [c[0].lower() + c[1:] + "WithName" for c in CHANNELS]
    objc = found.where((F.col("fact") == "label") & F.col("name").isin(*labels)).withColumn("text", F.col("of"))
    rows = _union([x.select("path", "line", "text") for x in (jvm, swift, objc)]).where("text IS NOT NULL")
    first = _channel_names(rows, found.where(F.col("fact") == "constant")).groupBy("path", F.col("channel").alias("name")).agg(F.min("line").alias("line"))
    framework = F.when(F.col("path").startswith("ios/"), "ios").otherwise("android")
    nodes = [_node(first, "native", id=F.col("path"), name=_base(), file=F.col("path"), framework=framework), _node(first, "channel", id=F.concat(F.lit("channel:"), "name"), name=F.col("name"), framework=F.lit("flutter"))]
    return Graph(_union(nodes), _edge(first, F.col("path"), F.concat(F.lit("channel:"), "name"), "handles"))


def package_name(files: DataFrame) -> DataFrame:
    """One row: the name in pubspec.yaml, null without one. [SRC-11]"""
    return files.where("path = 'pubspec.yaml'").agg(F.max(F.regexp_extract("content", r"(?m)^name:\s*(\S+)", 1)).alias("package"))


def dart(files: DataFrame) -> Graph:
    """Widgets, state containers, routes, navigation, calls and channels of Dart. [PRV-36..PRV-40, PRV-44, WIN-05]"""
    own = files_of(files, "dart")
    found = _written(facts(own))
    of_fact = lambda *kinds: found.where(F.col("fact").isin(*kinds))
    kind = F.when(F.col("base").isin(*WIDGETS), "component").when(F.col("base").isin(*CONTAINERS), "context")
    classes = of_fact("class").select("path", "offset", "line", "name", F.col("of").alias("base"), F.coalesce(F.get("args", F.lit(0))["text"], F.lit("")).alias("of"))
    classes = classes.withColumn("kind", kind)
    target = F.when(F.col("kind").isNotNull(), F.concat("path", F.lit("#"), "name")).when((F.col("base") == "State") & (F.col("of") != ""), F.concat("path", F.lit("#"), "of")).otherwise(F.col("path"))
    size = own.select("path", (F.size(F.split("content", "\n")) + 1).alias("lines"))
    classes = classes.withColumn("owner", target).withColumn("next", F.lead("line").over(Window.partitionBy("path").orderBy("offset"))).join(size, "path").withColumn("loc", F.coalesce("next", "lines") - F.col("line"))
    known = classes.where("kind IS NOT NULL").select("owner")
    classes = classes.join(known.withColumnRenamed("owner", "known").distinct(), F.col("owner") == F.col("known"), "left").withColumn("owner", F.coalesce("known", "path")).drop("known")
    classes = _written(classes)
    # a value made by a Provider class, not one that a provider of another kind looks up
    parts = F.split("of", r"\.")
    source = F.exists(parts, lambda x: x.rlike("Provider$")) & (F.element_at(parts, -1) != "of")
    providers = of_fact("made").where(source).select("path", F.lit(1).alias("line"), "name", F.concat("path", F.lit("#"), "name").alias("owner")).distinct()
    last = lambda df: df.groupBy("name").agg(F.max_by("owner", "path").alias("to"))
    widgets, containers = last(classes.where("kind = 'component'")), last(classes.where("kind = 'context'"))
    package = F.broadcast(package_name(files))
    imports = of_fact("import").withColumn("a", literal(F.col("name"))).select("path", "a").join(package, how="left")
    at_home = F.when(F.col("a").startswith("package:") & (F.regexp_extract("a", "^package:([^/]+)/", 1) == F.col("package")), F.concat(F.lit("lib/"), F.regexp_replace("a", "^package:[^/]+/", "")))
    imports = imports.withColumn("b", F.when(~F.col("a").contains(":"), F.concat(F.lit("./"), "a"))).withColumn("target", F.coalesce(at_home, resolve_path())).join(own.select(F.col("path").alias("target")), "target", "left_semi")
    calls_made = _written(owned(of_fact("call").withColumn("last", last_part()), classes))
    built = F.coalesce(argument("builder")["makes"], argument("pageBuilder")["makes"])
    go = calls_made.where("last = 'GoRoute'").select("path", "line", literal(argument("path")["text"]).alias("at"), built.alias("shown"))
    declared = go.unionByName(of_fact("entry").select("path", "line", literal(F.col("name")).alias("at"), F.col("of").alias("shown")).where("at LIKE '/%'")).where("at IS NOT NULL")
    declared = declared.withColumn("route", F.when(F.col("at").startswith("/"), F.col("at")).otherwise(F.concat(F.lit("/"), "at")))
    shows = declared.withColumn("name", F.col("shown")).join(widgets, "name")
    # a constructor is a capitalised name, or a named one of such: Card(...), Card.small(...)
    names = F.filter(F.split("name", r"\."), lambda x: x.rlike("^[A-Z]"))
    draws = calls_made.withColumn("name", F.element_at(F.when(F.size(names) > 0, names), -1)).join(widgets, "name").where(F.col("owner") != F.col("to"))
    aim = F.when(F.col("last").isin(*NAMED_MOVES), first_literal(2)).when(F.col("name").isin(*PATH_MOVES), first_literal(1))
    moves = calls_made.withColumn("aim", aim).where(F.col("aim").startswith("/")).withColumn("target", F.regexp_replace("aim", "[?#].*$", ""))
    moves = moves.join(canonical_routes(moves.select("target"), declared.select("route")), "target")
    client = F.lower(F.regexp_replace(F.get(F.split("name", r"\."), F.size(F.split("name", r"\.")) - 2), "^_", ""))
    method = F.regexp_extract(F.lower("last"), "^(" + "|".join(HTTP_METHODS) + ")", 1)
    calls = calls_made.where(F.col("name").contains(".")).where(client.isin(*HTTP_CLIENTS) & (method != "")).withColumn("url", to_pathname(first_literal(1))).where("url IS NOT NULL")
    calls = calls.withColumn("api", F.concat(F.upper(method), F.lit(" "), "url"))
    channels = calls_made.where(F.col("last").isin(*CHANNELS)).withColumn("text", F.get(F.col("args"), F.lit(0))["text"]).where("text IS NOT NULL").drop("name")
    channels = _channel_names(channels, of_fact("constant")).withColumnRenamed("channel", "name")
    watched = calls_made.where(F.col("name").isin("ref.watch", "ref.read", "ref.listen")).withColumn("name", F.regexp_extract(F.get(F.col("args"), F.lit(0))["text"], r"^(\w+)", 1))
    looked_up = calls_made.where(F.col("name").isin("Provider.of", "BlocProvider.of", "context.watch", "context.read")).withColumn("name", F.regexp_extract("of", r"^(\w+)", 1))
    uses = watched.join(last(providers), "name").unionByName(looked_up.join(containers, "name"))
    framework = F.lit("flutter")
    nodes = [
        _node(own, "file", id=F.col("path"), name=_base(), file=F.col("path"), framework=framework),
        _node(classes.where("kind = 'component'"), "component", id=F.col("owner"), name=F.col("name"), file=F.col("path"), loc=F.col("loc"), framework=framework),
        _node(classes.where("kind = 'context'").select("owner", "name", "path").unionByName(providers.select("owner", "name", "path")), "context", id=F.col("owner"), name=F.col("name"), file=F.col("path"), framework=framework),
        _node(declared, "route", id=F.concat(F.lit("route:"), "route"), name=F.col("route"), file=F.col("path"), framework=framework),
        _node(moves, "route", id=F.concat(F.lit("route:"), "route"), name=F.col("route"), framework=framework),
        _node(calls, "api", id=F.concat(F.lit("api:"), "api"), name=F.col("api")),
        _node(channels, "channel", id=F.concat(F.lit("channel:"), "name"), name=F.col("name"), framework=framework),
    ]
    edges = [
        _edge(classes.where("kind IS NOT NULL").select("path", "line", "owner").unionByName(providers.select("path", "line", "owner")), F.col("path"), F.col("owner"), "defines"),
        _edge(shows, F.concat(F.lit("route:"), "route"), F.col("to"), "routes_to"),
        _edge(imports.withColumn("line", F.lit(1)), F.col("path"), F.col("target"), "imports"),
        _edge(draws, F.col("owner"), F.col("to"), "renders"),
        _edge(moves, F.col("owner"), F.concat(F.lit("route:"), "route"), "navigates_to", F.when(F.col("confidence") < 1, F.col("confidence"))),
        _edge(calls, F.col("owner"), F.concat(F.lit("api:"), "api"), "calls"),
        _edge(channels, F.col("owner"), F.concat(F.lit("channel:"), "name"), "invokes"),
        _edge(uses, F.col("owner"), F.col("to"), "uses"),
    ]
    return Graph(_union(nodes), _union(edges))


PROVIDERS = {"frontend": frontend, "nestjs": nestjs, "dart": dart, "native": native}


def index_project(files: DataFrame) -> Graph:
    """All providers' outputs merged in their order, missing ends repaired, roles set. [PRV-05, SET-01]"""
    parts = [(i, Graph(_written(g.nodes), _written(g.edges))) for i, g in enumerate(PROVIDERS[p](files) for p in ORDER)]
    nodes = merge_nodes(_union([g.nodes.withColumn("ord", F.struct(F.lit(i).alias("p"), F.coalesce("file", F.lit("~")).alias("f"))) for i, g in parts]))
    edges = dedup_edges(_union([g.edges.withColumn("ord", F.struct(F.lit(i).alias("p"), "source")) for i, g in parts]))
    fixed = complete(repair(Graph(nodes, edges)), NODES)
    return Graph(normalize_roles(complete(nodes, NODES).unionByName(fixed)), edges)


def framework_of(files: DataFrame) -> DataFrame:
    """framework of the marker files that are there. [API-24]"""
    markers = F.when(F.col("path") == "pubspec.yaml", "flutter").when(F.col("path").rlike(r"^next\.config\.\w+$"), "nextjs").when(F.col("content").contains("@nestjs/"), "nestjs").when(F.col("content").rlike(r"from ['\"]react['\"]"), "react")
    return files.select(markers.alias("framework")).where("framework IS NOT NULL").distinct()
