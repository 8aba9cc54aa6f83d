"""The index of a set of repositories: chunks, symbols and edges from source files, all resolution by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.paths import prefixes
from chunkloom.operators import python_ast
from chunkloom.session import cut

BASE_DEPTH = 6


def identity(*parts: str) -> Column:
    """A stable id in the form of a uuid, made from what a row is about; runs repeat it."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def chunk_table(files: DataFrame) -> DataFrame:
    """Chunks with ids, embedding left null."""
    c = python_ast.chunks(files)
    c = c.withColumn("id", identity("repo_id", "file_path", "chunk_type", "parent_symbol", "symbol_name", "start_line"))
    return c.select("id", *python_ast.CHUNK_COLUMNS, F.lit(None).cast("array<float>").alias("embedding")).dropDuplicates(["id"])


def symbol_table(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Symbols, the first of each name in a repository, with the chunk that holds each."""
    s = facts.filter("fact = 'symbol'")
    w = Window.partitionBy("repo_id", "scope").orderBy("file_path", "ordinal")
    s = s.withColumn("n", F.row_number().over(w)).filter("n = 1")
    s = s.select("repo_id", F.col("scope").alias("qualified_name"), F.col("form").alias("kind"), "file_path", "line", F.col("a").alias("s_name"), F.col("b").alias("s_parent"))
    c = chunks.select("repo_id", "file_path", F.col("chunk_type").alias("kind"), F.col("symbol_name").alias("s_name"), F.col("parent_symbol").alias("c_parent"), F.col("start_line").alias("line"), F.col("id").alias("chunk_id"))
    s = s.join(c, (s.repo_id == c.repo_id) & (s.file_path == c.file_path) & (s.kind == c.kind) & (s.s_name == c.s_name) & (s.line == c.line) & s.s_parent.eqNullSafe(c.c_parent), "left").select(s["*"], "chunk_id")
    return s.withColumn("id", identity("repo_id", "qualified_name")).select("id", "repo_id", "qualified_name", "kind", "file_path", "line", "chunk_id")


def best_modules(candidates: DataFrame, modules: DataFrame) -> DataFrame:
    """For rows (repo_id, key, candidates) the longest prefix of the first candidate that has one among the modules: (repo_id, key, module)."""
    c = candidates.select("repo_id", "key", F.posexplode("candidates").alias("at", "candidate"))
    c = c.select("repo_id", "key", "at", F.explode(prefixes(F.col("candidate"))).alias("prefix"))
    m = c.join(modules.select("repo_id", F.col("module").alias("prefix")), ["repo_id", "prefix"])
    return m.groupBy("repo_id", "key").agg(F.min_by("prefix", F.struct("at", -F.length("prefix"))).alias("module"))


class Graph:
    """Facts, symbols and the bindings of names in modules; its methods give the edges of each type."""

    def __init__(self, facts: DataFrame, symbols: DataFrame):
        self.facts = facts.withColumn("key", F.concat_ws("\x1f", "file_path", F.col("ordinal").cast("string")))
        self.names = symbols.select("repo_id", "qualified_name").withColumnRenamed("qualified_name", "name")
        self.modules = symbols.filter("kind = 'module'").select("repo_id", F.col("qualified_name").alias("module"))
        self.bindings = cut(self._bindings(symbols))
        self.bases = cut(self._bases())
        self.ancestors = cut(self._ancestors())

    def known(self, df: DataFrame, column: str) -> DataFrame:
        """df with `column` set to null where it is the name of no symbol."""
        n = self.names.select(F.col("repo_id").alias("__r"), F.col("name").alias("__n"))
        j = df.join(n, (df.repo_id == n["__r"]) & (df[column] == n["__n"]), "left")
        return j.withColumn(column, F.col("__n")).drop("__r", "__n")

    def _bindings(self, symbols: DataFrame) -> DataFrame:
        """(repo_id, module, local, target, function, class): what a name of a module stands for; imports go before definitions."""
        a = self.facts.filter("fact = 'alias'").select("repo_id", "module", "key", "ordinal", F.col("a").alias("local"), "form", "b", "c")
        by_name = best_modules(a.select("repo_id", "key", F.array("c").alias("candidates")), self.modules).withColumnRenamed("module", "named")
        by_base = best_modules(a.filter("b is not null").select("repo_id", "key", F.array("b").alias("candidates")), self.modules).withColumnRenamed("module", "based")
        a = a.join(by_name, ["repo_id", "key"], "left").join(by_base, ["repo_id", "key"], "left")
        a = a.withColumn("target", F.when((F.col("form") == "from") & F.col("based").isNotNull(), F.concat_ws(".", "b", "c")).otherwise(F.col("named"))).filter("target is not null")
        a = a.groupBy("repo_id", "module", "local").agg(F.max_by("target", "ordinal").alias("target"))
        d = self.facts.filter("fact = 'symbol' and form in ('function', 'class')").groupBy("repo_id", "module", F.col("a").alias("local")).agg(F.max(F.col("form") == "function").alias("function"), F.max(F.col("form") == "class").alias("class"))
        return a.join(d, ["repo_id", "module", "local"], "full_outer").select("repo_id", "module", "local", "target", F.coalesce("function", F.lit(False)).alias("function"), F.coalesce("class", F.lit(False)).alias("class"))

    def bound(self, df: DataFrame, column: str) -> DataFrame:
        """df with target, function and class of the name in `column`, as its module binds it."""
        return df.join(self.bindings.withColumnRenamed("local", column), ["repo_id", "module", column], "left")

    def classes_meant(self, df: DataFrame, name: str, attribute: str) -> DataFrame:
        """df with `meant`: the internal symbol that a base or constructor stands for, null for none."""
        j = self.bound(df, name)
        here = F.concat_ws(".", "module", name)
        meant = F.when(F.col("form") == "name", F.coalesce("target", F.when(F.col("class"), here))).when((F.col("form") == "attr") & F.col("target").isNotNull(), F.concat_ws(".", "target", attribute))
        return self.known(j.withColumn("meant", meant).drop("target", "function", "class"), "meant")

    def _bases(self) -> DataFrame:
        """(repo_id, class, base, ordinal, line) of internal base classes, a class itself never its base."""
        b = self.facts.filter("fact = 'base'").select("repo_id", "module", "scope", "form", "a", "b", "line", "ordinal")
        m = self.classes_meant(b, "a", "b").filter("meant is not null and meant <> scope")
        return m.select("repo_id", F.col("scope").alias("class"), F.col("meant").alias("base"), "ordinal", "line")

    def _ancestors(self) -> DataFrame:
        """(repo_id, class, ancestor, place): each class above another at its nearest place, breadth first to BASE_DEPTH; place orders them."""
        b = self.bases.select("repo_id", F.col("class").alias("ancestor"), F.col("base").alias("next"), "ordinal")
        level = self.bases.select("repo_id", "class", F.col("base").alias("ancestor"), F.array(F.lit(1), F.col("ordinal")).alias("place"))
        every = level = cut(level.groupBy("repo_id", "class", "ancestor").agg(F.min("place").alias("place")))
        for depth in range(2, BASE_DEPTH + 1):
            step = level.join(b, ["repo_id", "ancestor"]).select("repo_id", "class", F.col("next").alias("ancestor"), F.concat(F.array(F.lit(depth)), F.slice("place", 2, depth), F.array(F.col("ordinal"))).alias("place")).filter("ancestor <> class")
            step = step.join(every.select("repo_id", "class", "ancestor"), ["repo_id", "class", "ancestor"], "left_anti").groupBy("repo_id", "class", "ancestor").agg(F.min("place").alias("place"))
            level = cut(step)
            if level.isEmpty():
                break
            every = every.unionByName(level)
        return every

    def attributes(self, asked: DataFrame) -> DataFrame:
        """(repo_id, owner, attribute, found) of asked (repo_id, owner, attribute): the owner's own, else that of the nearest ancestor."""
        own = asked.select("repo_id", "owner", "attribute", F.col("owner").alias("holder"), F.array(F.lit(0)).alias("place"))
        up = asked.join(self.ancestors.withColumnRenamed("class", "owner"), ["repo_id", "owner"]).select("repo_id", "owner", "attribute", F.col("ancestor").alias("holder"), "place")
        c = self.known(own.unionByName(up).withColumn("found", F.concat_ws(".", "holder", "attribute")), "found").filter("found is not null")
        return c.groupBy("repo_id", "owner", "attribute").agg(F.min_by("found", "place").alias("found"))

    def inherits(self) -> DataFrame:
        return self.bases.groupBy("repo_id", F.col("class").alias("source"), F.col("base").alias("target")).agg(F.min("line").alias("line"))

    def imports(self) -> DataFrame:
        i = self.facts.filter("fact = 'import'")
        m = i.select("repo_id", "key", F.col("module").alias("source"), "line").join(best_modules(i.select("repo_id", "key", "candidates"), self.modules).withColumnRenamed("module", "target"), ["repo_id", "key"])
        return m.filter("source <> target").groupBy("repo_id", "source", "target").agg(F.min("line").alias("line"))

    def local_types(self) -> DataFrame:
        """(repo_id, scope, variable, type): locals constructed from one internal class; those given another later are left out."""
        a = self.facts.filter("fact = 'assign'").select("repo_id", "module", "scope", "form", "a", "b", F.col("c").alias("variable"), "ordinal")
        m = self.classes_meant(a, "a", "b")
        first = F.min(F.when(F.col("meant").isNotNull(), F.col("ordinal"))).over(Window.partitionBy("repo_id", "scope", "variable"))
        m = m.withColumn("first", first).filter("ordinal >= first")
        g = m.groupBy("repo_id", "scope", "variable").agg(F.count_distinct(F.coalesce("meant", F.lit(""))).alias("n"), F.max("meant").alias("type"))
        return g.filter("n = 1").select("repo_id", "scope", "variable", "type")

    def calls(self) -> DataFrame:
        """Distinct (repo_id, source, target, line): a name by import, then by definition; self by class and ancestors; locals by
        the class they were made of; else the prefix that an import or a function gives. Calls of oneself are left out."""
        c = self.bound(self.facts.filter("fact = 'call' and form <> 'other'").select("repo_id", "module", "scope", "owner", "form", "a", "b", "c", "line"), "a")
        here = F.when(F.col("function"), F.concat_ws(".", "module", "a"))
        c = c.join(self.local_types().withColumnRenamed("variable", "a"), ["repo_id", "scope", "a"], "left")
        c = c.withColumn("holder", F.when(F.col("form") == "self", F.col("owner")).when(F.col("form") == "attr", F.col("type")))
        asked = c.filter("holder is not null").select("repo_id", F.col("holder").alias("owner"), F.col("b").alias("attribute")).distinct()
        found = self.attributes(asked).select("repo_id", F.col("owner").alias("holder"), F.col("attribute").alias("b"), "found")
        c = c.join(found, ["repo_id", "holder", "b"], "left")
        other = F.when(F.col("form") == "name", F.coalesce("target", here)).when(F.col("form") == "attr", F.concat(F.coalesce("target", here), F.lit("."), "b")).when(F.col("form") == "deep", F.concat("target", F.lit("."), "b", F.lit("."), "c"))
        c = self.known(c.withColumn("direct", F.when(F.col("form") != "self", other)), "direct")
        out = c.select("repo_id", F.col("scope").alias("source"), F.coalesce("found", "direct").alias("target"), "line")
        return out.filter("target is not null and source <> target").distinct()

    def references(self) -> DataFrame:
        """(repo_id, source, target, line): symbols that are no modules, read and not called in a body; one row a pair, the first line."""
        r = self.bound(self.facts.filter("fact = 'load'").select("repo_id", "module", "scope", "a", "line", "ordinal"), "a")
        target = F.coalesce("target", F.when(F.col("function") | F.col("class"), F.concat_ws(".", "module", "a")))
        r = r.select("repo_id", F.col("scope").alias("source"), target.alias("target"), "line", "ordinal").filter("target is not null and target <> source")
        r = self.known(r, "target").filter("target is not null").join(self.modules.withColumnRenamed("module", "target"), ["repo_id", "target"], "left_anti")
        return r.groupBy("repo_id", "source", "target").agg(F.min_by("line", "ordinal").alias("line"))


def edge_table(graph: Graph, symbols: DataFrame) -> DataFrame:
    """All edges with the ids of their ends; ends that are no symbol give none."""
    parts = [f().withColumn("edge_type", F.lit(t)) for t, f in (("imports", graph.imports), ("calls", graph.calls), ("inherits", graph.inherits), ("references", graph.references))]
    e = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    s = symbols.select("repo_id", F.col("qualified_name").alias("source"), F.col("id").alias("source_id"))
    t = symbols.select("repo_id", F.col("qualified_name").alias("target"), F.col("id").alias("target_id"))
    e = e.join(s, ["repo_id", "source"]).join(t, ["repo_id", "target"])
    return e.withColumn("id", identity("repo_id", "source_id", "target_id", "edge_type", "line")).select("id", "repo_id", "source_id", "target_id", "edge_type", F.col("line").alias("source_line"))


def build(files: DataFrame) -> dict[str, DataFrame]:
    """chunks, symbols and edges of Python files (repo_id, file_path, source), each file given once.

    Files are parsed twice, for chunks and for facts; both are kept in the shared folder, as many joins read them.
    """
    py = files.filter(F.endswith("file_path", F.lit(".py"))).select("repo_id", "file_path", "source").dropDuplicates(["repo_id", "file_path"])
    chunks = cut(chunk_table(py))
    facts = cut(python_ast.facts(py))
    symbols = cut(symbol_table(facts, chunks))
    return {"chunks": chunks, "symbols": symbols, "edges": edge_table(Graph(facts, symbols), symbols)}
