"""Grammar of the dialect, by recursive descent. Pure: no table or session is needed."""

from __future__ import annotations

import datetime

from . import ast
from .errors import SQLParseError, SQLUnsupportedError
from .lexer import Token, tokenize

#: Words of SQL that the dialect leaves out.
REJECTED = frozenset("ALTER AS COMMIT DISTINCT EXCEPT HAVING IN INTERSECT IS LIKE NOT NULL OFFSET OR ROLLBACK UNION UPDATE VIEW".split())
#: Names of types and indexes, with their long forms.
TYPES = {"INT": "INT", "INTEGER": "INT", "DOUBLE": "DOUBLE", "VARCHAR": "VARCHAR", "BOOL": "BOOL", "BOOLEAN": "BOOL", "DATE": "DATE", "POINT": "POINT", "VECTOR": "VECTOR"}
INDEXES = {"BPLUS": "BPLUS", "BPLUS_TREE": "BPLUS", "HASH": "HASH", "EXTENDIBLE_HASH": "HASH", "RTREE": "RTREE", "FULLTEXT": "FULLTEXT", "INVERTED_INDEX": "FULLTEXT", "HNSW": "HNSW", "IVF": "IVF"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
METRICS = {"EUCLIDEAN": "euclidean", "COSINE": "cosine", "DOT": "dot"}
LANGUAGES = {"SPANISH": "spanish", "ENGLISH": "english"}
RESERVED = frozenset("SELECT FROM WHERE JOIN ON GROUP ORDER BY LIMIT INSERT INTO VALUES DELETE CREATE DROP TABLE INDEX USING AND BETWEEN EXPLAIN".split())


class Parser:
    def __init__(self, sql: str):
        self.tokens, self.at = tokenize(sql), 0

    # --- tokens

    @property
    def here(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.here
        self.at += t.kind != "end"
        return t

    def fail(self, expected: str) -> SQLParseError:
        t = self.here
        if t.word() in REJECTED or t.word() == "AND":
            return SQLUnsupportedError(f"{t.word()} is not supported", t.span)
        return SQLParseError(f"expected {expected}, found {t.text or 'the end'}", t.span)

    def is_word(self, *words: str) -> bool:
        return self.here.word() in words

    def accept(self, *words: str) -> Token | None:
        return self.next() if self.is_word(*words) else None

    def word(self, *words: str) -> Token:
        if not self.is_word(*words):
            raise self.fail(" or ".join(words))
        return self.next()

    def is_symbol(self, *symbols: str) -> bool:
        return self.here.kind == "symbol" and self.here.text in symbols

    def accept_symbol(self, *symbols: str) -> Token | None:
        return self.next() if self.is_symbol(*symbols) else None

    def symbol(self, *symbols: str) -> Token:
        if not self.is_symbol(*symbols):
            raise self.fail(" or ".join(symbols))
        return self.next()

    def identifier(self, what: str = "a name") -> Token:
        if self.here.kind != "name" or self.here.word() in RESERVED or self.here.word() in REJECTED:
            raise self.fail(what)
        return self.next()

    # --- statements

    def script(self) -> list:
        out = []
        while True:
            while self.accept_symbol(";"):
                pass
            if self.here.kind == "end":
                return out
            out.append(self.statement())
            if self.here.kind != "end" and not self.is_symbol(";"):
                raise self.fail("; or the end")

    def statement(self):
        t = self.here
        first = {"SELECT": self.select, "EXPLAIN": self.explain, "CREATE": self.create, "INSERT": self.insert, "DELETE": self.delete, "DROP": self.drop, "BEGIN": self.transaction, "END": self.transaction}
        if t.word() not in first:
            raise self.fail("a statement")
        return first[t.word()]()

    def transaction(self):
        t = self.next()
        self.word("TRANSACTION")
        return ast.Begin(t.span) if t.word() == "BEGIN" else ast.End(t.span)

    def explain(self):
        self.next()
        analyze = bool(self.accept("ANALYZE"))
        if not self.is_word("SELECT"):
            raise self.fail("SELECT")
        return ast.Explain(self.select(), analyze)

    def create(self):
        begin = self.next()
        if self.accept("TABLE"):
            return self.create_table(begin)
        self.word("INDEX")
        name = self.identifier("an index name").text
        self.word("ON")
        table = self.identifier("a table name").text
        self.symbol("(")
        column = self.identifier("a column name").text
        self.symbol(")")
        self.word("USING")
        kind = INDEXES[self.word(*INDEXES).word()]
        metric = language = None
        while self.accept("WITH"):
            option = self.word("METRIC", "LANGUAGE")
            self.symbol("=")
            if option.word() == "METRIC" and kind == "HNSW" and metric is None:
                metric = METRICS[self.word(*METRICS).word()]
            elif option.word() == "LANGUAGE" and kind == "FULLTEXT" and language is None:
                language = LANGUAGES[self.word(*LANGUAGES).word()]
            else:
                raise SQLParseError(f"{option.word()} does not belong to this index", option.span)
        if kind == "HNSW":
            metric = metric or "cosine"
        if kind == "FULLTEXT":
            language = language or "spanish"
        return ast.CreateIndex(name, table, column, kind, begin.span, metric, language)

    def create_table(self, begin: Token):
        table = self.identifier("a table name").text
        self.symbol("(")
        columns = [self.column_def()]
        while self.accept_symbol(","):
            columns.append(self.column_def())
        self.symbol(")")
        storage, node, by, fragments = "HEAP", None, None, []
        if self.accept("USING"):
            storage = self.word("HEAP", "SEQUENTIAL").word()
        if self.accept("ON"):
            node = self.identifier("a node").text
        elif self.accept("PARTITION"):
            self.word("BY")
            self.word("RANGE")
            self.symbol("(")
            by = self.identifier("a column name").text
            self.symbol(")")
            self.symbol("(")
            while True:
                self.word("PARTITION")
                name = self.identifier("a partition name").text
                for w in ("VALUES", "LESS", "THAN"):
                    self.word(w)
                self.symbol("(")
                below = None if self.accept("MAXVALUE") else self.integer("a bound")
                self.symbol(")")
                self.word("ON")
                fragments.append(ast.Fragment(name, below, self.identifier("a node").text))
                if not self.accept_symbol(","):
                    break
            self.symbol(")")
        return ast.CreateTable(table, tuple(columns), storage, begin.span, node, by, tuple(fragments))

    def column_def(self):
        name = self.identifier("a column name")
        kind = TYPES[self.word(*TYPES).word()]
        size = None
        if kind in ("VARCHAR", "VECTOR"):
            self.symbol("(")
            size = self.integer("a size")
            self.symbol(")")
        key = bool(self.accept("PRIMARY"))
        if key:
            self.word("KEY")
        return ast.ColumnDef(name.text, kind, size, key, name.span)

    def integer(self, what: str) -> int:
        if self.here.kind != "int":
            raise self.fail(what)
        return self.next().value

    def drop(self):
        begin = self.next()
        self.word("TABLE")
        return ast.DropTable(self.identifier("a table name").text, begin.span)

    def insert(self):
        begin = self.next()
        self.word("INTO")
        table = self.identifier("a table name").text
        self.word("VALUES")
        self.symbol("(")
        values = [self.literal()]
        while self.accept_symbol(","):
            values.append(self.literal())
        self.symbol(")")
        return ast.Insert(table, tuple(values), begin.span)

    def delete(self):
        begin = self.next()
        self.word("FROM")
        table = self.identifier("a table name").text
        self.word("WHERE")
        return ast.Delete(table, self.condition(), begin.span)

    def select(self):
        begin = self.word("SELECT")
        items = [self.item()]
        while self.accept_symbol(","):
            items.append(self.item())
        self.word("FROM")
        table = self.identifier("a table name").text
        join = None
        if t := self.accept("JOIN"):
            other = self.identifier("a table name").text
            self.word("ON")
            left = self.column()
            self.symbol("=")
            join = ast.Join(other, left, self.column(), t.span)
            if self.is_word("JOIN"):
                raise SQLUnsupportedError("only one JOIN is supported", self.here.span)
        where = self.condition() if self.accept("WHERE") else None
        if self.is_word("AND"):
            raise SQLUnsupportedError("AND is not supported outside BETWEEN", self.here.span)
        group = order = limit = None
        if self.accept("GROUP"):
            self.word("BY")
            group = self.column()
            if self.is_symbol(","):
                raise SQLUnsupportedError("only one GROUP BY column is supported", self.here.span)
        if self.accept("ORDER"):
            self.word("BY")
            order = self.order_by()
        if self.accept("LIMIT"):
            t = self.here
            limit = self.integer("a number of rows")
            if limit < 0:
                raise SQLParseError("LIMIT must not be negative", t.span)
        return ast.Select(tuple(items), table, begin.span, join, where, group, order, limit)

    def item(self):
        if t := self.accept_symbol("*"):
            return ast.Star(t.span)
        call = self.ahead().text == "("
        if call and self.is_word("SCORE", "SIMILARITY_SCORE"):
            return self.score_call(True)
        if call and self.is_word(*AGGREGATES):
            f = self.next()
            self.symbol("(")
            star = self.accept_symbol("*")
            if star and f.word() != "COUNT":
                raise SQLParseError(f"{f.word()} needs a column", star.span)
            if not star and f.word() == "COUNT":
                raise SQLUnsupportedError("only COUNT(*) is supported", self.here.span)
            column = None if star else self.column()
            self.symbol(")")
            return ast.Aggregate(f.word(), column, f.span)
        return self.column()

    def score_call(self, aliased: bool):
        f = self.next()
        self.symbol("(")
        self.symbol(")")
        kind = f.text.lower()
        alias = self.identifier("an alias").text if aliased and self.accept("AS") else kind
        return ast.ScoreCall(kind, alias, f.span)

    def column(self):
        a = self.identifier("a column")
        if self.accept_symbol("."):
            b = self.identifier("a column")
            return ast.ColumnRef(a.text, b.text, a.span)
        return ast.ColumnRef(None, a.text, a.span)

    def order_by(self):
        if self.is_word("SCORE", "SIMILARITY_SCORE") and self.ahead().text == "(":
            key = self.score_call(False)
        elif self.is_word("DISTANCIA") and self.ahead().text == "(":
            key = self.distance()
        else:
            key = self.column()
        descending = bool(self.accept("DESC"))
        if not descending:
            self.accept("ASC")
        if self.is_symbol(","):
            raise SQLUnsupportedError("only one ORDER BY key is supported", self.here.span)
        return ast.OrderBy(key, descending)

    # --- conditions

    def condition(self):
        call = self.ahead().text == "("
        if call and self.is_word("MATCH"):
            return self.match()
        if call and self.is_word("SIMILAR_TO"):
            return self.similar()
        if call and self.is_word("DENTRO"):
            t = self.next()
            self.symbol("(")
            column = self.column()
            self.symbol(",")
            self.word("POLYGON")
            self.symbol("(")
            ring = [self.point()]
            while self.accept_symbol(","):
                ring.append(self.point())
            self.symbol(")")
            self.symbol(")")
            return ast.Inside(column, tuple(ring), t.span)
        if call and self.is_word("DISTANCIA"):
            d = self.distance()
            if not self.is_symbol("<", "<="):
                raise SQLUnsupportedError("a distance is compared by < or <= only", self.here.span)
            op = self.next().text
            return ast.Within(d.column, d.point, d.metric, op, self.literal())
        column = self.column()
        if self.accept("BETWEEN"):
            low = self.literal()
            self.word("AND")
            return ast.Compare(column, "between", low, self.literal())
        op = self.symbol("=", "<", "<=", ">", ">=").text
        if self.here.kind == "name" and self.here.word() not in ("TRUE", "FALSE", "DATE", "POINT", "VECTOR", "NULL"):
            raise SQLUnsupportedError("a column is compared with a literal only", self.here.span)
        return ast.Compare(column, op, self.literal())

    def distance(self):
        self.next()
        self.symbol("(")
        column = self.column()
        self.symbol(",")
        point = self.point()
        metric = "haversine"
        if self.accept_symbol(","):
            metric = self.word("HAVERSINE", "EUCLIDEAN").text.lower()
        self.symbol(")")
        return ast.Within(column, point, metric, "", None)

    def match(self):
        t = self.next()
        self.symbol("(")
        column = self.column()
        self.symbol(",")
        if self.here.kind != "string":
            raise self.fail("a string")
        query = self.next().value
        self.symbol(")")
        ranking = self.word("TF_IDF", "BM25").word() if self.accept("USING") else "BM25"
        return ast.Match(column, query, ranking, t.span)

    def similar(self):
        t = self.next()
        self.symbol("(")
        column = None
        if self.here.kind == "name" and not (self.is_word("VECTOR") and self.ahead().text == "("):
            column = self.column()
            self.symbol(",")
        target = self.literal()
        if target.kind not in ("vector", "string"):
            raise SQLParseError("expected a VECTOR or a file name", target.span)
        self.symbol(",")
        if self.accept("K"):
            self.symbol("=")
        k = self.integer("k")
        self.symbol(")")
        self.word("USING")
        index = self.word("HNSW", "IVF").word()
        metric = "cosine"
        if self.accept("WITH"):
            self.word("METRIC")
            self.symbol("=")
            metric = METRICS[self.word(*METRICS).word()]
        return ast.Similar(column, target, k, index, metric, t.span)

    # --- literals

    def literal(self):
        t = self.here
        if t.kind in ("int", "float", "string"):
            self.next()
            return ast.Literal({"int": "int", "float": "double", "string": "string"}[t.kind], t.value, t.span)
        if self.is_word("TRUE", "FALSE"):
            return ast.Literal("bool", self.next().word() == "TRUE", t.span)
        if self.is_word("DATE"):
            self.next()
            if self.here.kind != "string":
                raise self.fail("a date in quotes")
            d = self.next()
            try:
                if len(d.value) != 10:
                    raise ValueError
                return ast.Literal("date", datetime.date.fromisoformat(d.value), d.span)
            except ValueError:
                raise SQLParseError(f"{d.text} is not a date of the form YYYY-MM-DD", d.span) from None
        if self.is_word("POINT"):
            return self.point()
        if self.is_word("VECTOR"):
            self.next()
            self.symbol("(")
            values = [self.number()]
            while self.accept_symbol(","):
                values.append(self.number())
            self.symbol(")")
            return ast.Literal("vector", tuple(values), t.span)
        raise self.fail("a literal")

    def number(self) -> float:
        if self.here.kind not in ("int", "float"):
            raise self.fail("a number")
        return float(self.next().value)

    def point(self):
        t = self.word("POINT")
        self.symbol("(")
        lat = self.number()
        self.symbol(",")
        lon = self.number()
        self.symbol(")")
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise SQLParseError("a point is (latitude from -90 to 90, longitude from -180 to 180)", t.span)
        return ast.Literal("point", (lat, lon), t.span)


def parse_sql(sql: str):
    """The one statement of a text."""
    found = parse_sql_script(sql)
    if len(found) != 1:
        raise SQLParseError(f"expected one statement, found {len(found)}")
    return found[0]


def parse_sql_script(sql: str) -> list:
    """All statements of a ;-separated text; it is parsed to the end before any runs."""
    return Parser(sql).script()
