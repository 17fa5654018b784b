import pytest

from ledgerlight.model import Model, ModelError, Relation, Table
from ledgerlight.plans.guard import PolicyError, error_kind, guarded_sql, with_timeout

T = {
    "orders": ("order_id", {"order_id": "int", "customer_id": "int", "amount": "double", "d": "date"}),
    "refunds": ("refund_id", {"refund_id": "int", "order_id": "int", "amount": "double"}),
    "customers": ("customer_id", {"customer_id": "int", "name": "string"}),
    "sales": ("sale_id", {"sale_id": "int", "key": "int", "sale_date": "date", "amount": "double"}),
    "observations": ("key", {"key": "int", "record_date": "date", "amount": "double"}),
    "versions": ("version_id", {"version_id": "int", "valid_from": "date", "valid_to": "date", "price": "double"}),
    "calendar": ("day", {"day": "date"}),
}
MODEL = Model(
    {n: Table(n, (g,), c) for n, (g, c) in T.items()},
    [
        Relation("orders", "customers", (("customer_id", "customer_id"),)),
        Relation("refunds", "orders", (("order_id", "order_id"),)),
        Relation("sales", "observations", (("key", "key"), ("sale_date", "record_date"))),
        Relation("calendar", "versions", point="day", start="valid_from", end="valid_to", allow_open_end=True),
    ],
).check()


@pytest.fixture(scope="module")
def db(spark):
    for n, (_, cols) in T.items():
        spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in cols.items())).createOrReplaceTempView(n)
    spark.sql("SELECT * FROM VALUES (1, 1, 10.0D, DATE'2025-01-01'), (2, 1, 20.0D, DATE'2025-01-02'), (3, 2, 5.0D, DATE'2025-01-03') AS t(order_id, customer_id, amount, d)").createOrReplaceTempView("orders")
    spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(customer_id, name)").createOrReplaceTempView("customers")
    return spark


ACCEPTED = [
    "SELECT c.name, sum(o.amount) AS total FROM orders o JOIN customers c ON o.customer_id = c.customer_id GROUP BY c.name",
    "SELECT c.name, o.amount FROM customers c LEFT JOIN orders o ON c.customer_id = o.customer_id AND o.amount = 10.0D",
    "WITH x AS (SELECT customer_id AS k, amount FROM orders) SELECT c.name, x.amount FROM x JOIN customers c ON x.k = c.customer_id",
    "WITH x(k, a) AS (SELECT customer_id, amount FROM orders) SELECT c.name, x.a FROM x JOIN customers c ON x.k = c.customer_id",
    "SELECT q.name, o.amount FROM (SELECT * FROM customers) q JOIN orders o ON q.customer_id = o.customer_id",
    "SELECT c.name FROM (SELECT customer_id FROM orders UNION ALL SELECT customer_id FROM orders) u JOIN customers c ON u.customer_id = c.customer_id",
    "SELECT s.amount, b.amount AS seen FROM sales s JOIN observations b ON s.key = b.key AND s.sale_date = b.record_date",
    "SELECT c.day, sum(v.price) AS mrr FROM calendar c JOIN versions v ON c.day >= v.valid_from AND (c.day < v.valid_to OR v.valid_to IS NULL) GROUP BY c.day",
    "SELECT order_id, row_number() OVER (ORDER BY amount DESC) AS rn FROM orders ORDER BY rn LIMIT 2",
    "SELECT * EXCEPT (amount), replace(CAST(d AS STRING), '-', '') AS day FROM orders",
    "SELECT customer_id FROM orders INTERSECT SELECT customer_id FROM customers",
]
WITH_SUBQUERIES = [
    "SELECT name FROM customers c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.customer_id = c.customer_id)",
    "SELECT name FROM customers c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.customer_id = c.customer_id)",
    "SELECT order_id FROM orders WHERE amount > (SELECT avg(amount) FROM orders)",
    "SELECT order_id FROM orders WHERE customer_id IN (SELECT customer_id FROM customers)",
    "SELECT order_id FROM orders WHERE customer_id NOT IN (SELECT customer_id FROM orders WHERE amount > 15)",
    "SELECT order_id FROM orders WHERE customer_id IN (SELECT q.k FROM (SELECT customer_id AS k FROM customers) q)",
    "SELECT order_id FROM orders WHERE amount > (SELECT max(amount) - 1 FROM orders)",
    "SELECT order_id FROM orders WHERE amount >= (SELECT amount FROM orders ORDER BY amount DESC LIMIT 1)",
    "SELECT order_id, (SELECT max(c.name) FROM customers c WHERE c.customer_id = o.customer_id) AS name FROM orders o",
]
REJECTED_SUBQUERIES = [
    "SELECT order_id FROM orders WHERE customer_id IN (SELECT order_id FROM orders)",
    "SELECT order_id FROM orders WHERE customer_id NOT IN (SELECT order_id FROM orders)",
    "SELECT order_id FROM orders WHERE customer_id + 0 IN (SELECT customer_id FROM customers)",
    "SELECT order_id FROM orders WHERE customer_id IN (SELECT customer_id + 0 FROM customers)",
    "SELECT order_id FROM orders WHERE (customer_id, order_id) IN (SELECT customer_id, order_id FROM orders)",
    "SELECT order_id FROM orders WHERE amount > (SELECT customer_id FROM customers)",
    "SELECT order_id FROM orders WHERE amount > (SELECT max(amount) FROM orders GROUP BY customer_id)",
    "SELECT order_id FROM orders WHERE amount > (SELECT amount FROM orders LIMIT 2)",
    "SELECT order_id FROM orders WHERE amount > (SELECT sum(amount) OVER () FROM orders)",
]
REJECTED = [
    "DELETE FROM orders", "DROP TABLE orders", "CREATE TABLE z AS SELECT 1", "SET a = b", "SELECT 1; SELECT 2", "INSERT INTO orders SELECT * FROM orders", "CACHE TABLE orders", "DESCRIBE orders", "SHOW TABLES",
    "SELECT * FROM secret", "SELECT * FROM default.orders", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM range(10)",
    "SELECT reflect('java.lang.System', 'exit', '0')", "SELECT java_method('java.lang.System', 'exit', '0')", "SELECT my.f(1) FROM orders", "SELECT sha2(name, 256) FROM customers", "SELECT input_file_name() FROM orders",
    "SELECT o.amount FROM orders o, customers c", "SELECT o.amount FROM orders o CROSS JOIN customers c", "SELECT o.amount FROM orders o NATURAL JOIN customers c", "SELECT o.amount FROM orders o JOIN customers c USING (customer_id)",
    "SELECT o.amount FROM orders o JOIN customers c ON o.order_id = c.customer_id", "SELECT o.amount FROM orders o JOIN customers c ON o.customer_id = c.customer_id OR o.order_id = 1", "SELECT o.amount FROM orders o JOIN customers c ON o.customer_id + 1 = c.customer_id",
    "SELECT o.amount FROM orders o JOIN customers c ON o.customer_id > c.customer_id", "SELECT o.amount FROM orders o JOIN customers c ON true", "WITH x AS (SELECT customer_id + 0 AS k FROM orders) SELECT c.name FROM x JOIN customers c ON x.k = c.customer_id",
    "WITH x AS (SELECT order_id AS customer_id FROM orders) SELECT c.name FROM x JOIN customers c ON x.customer_id = c.customer_id", "SELECT c.name FROM (SELECT customer_id FROM orders UNION ALL SELECT order_id FROM orders) u JOIN customers c ON u.customer_id = c.customer_id",
    "SELECT s.amount FROM sales s JOIN observations b ON s.key = b.key", "SELECT a.amount FROM refunds a JOIN refunds b ON a.order_id = b.order_id", "SELECT c.day FROM calendar c JOIN versions v ON c.day >= v.valid_from", "SELECT c.day FROM calendar c JOIN versions v ON c.day >= v.valid_from AND c.day < v.valid_to",
    "SELECT c.day FROM calendar c JOIN versions v ON c.day > v.valid_from AND (c.day < v.valid_to OR v.valid_to IS NULL)", "SELECT c.day FROM calendar c JOIN versions v ON c.day >= v.valid_from AND (c.day <= v.valid_to OR v.valid_to IS NULL)",
    "SELECT amount, amount FROM orders", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r", "SELECT order_id FROM orders WHERE amount > (SELECT avg(amount) FROM orders)", "SELECT 1 FROM orders WHERE" + " 1 = 1 AND" * 4000 + " 1 = 1",
]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(db, sql):
    guarded_sql(db, sql, MODEL).collect()


@pytest.mark.parametrize("sql", WITH_SUBQUERIES)
def test_subqueries_only_where_allowed(db, sql):
    guarded_sql(db, sql, MODEL, subqueries=True).collect()
    with pytest.raises(PolicyError):
        guarded_sql(db, sql, MODEL)


@pytest.mark.parametrize("sql", REJECTED_SUBQUERIES)
def test_subqueries_off_the_model_are_rejected(db, sql):
    with pytest.raises(PolicyError):
        guarded_sql(db, sql, MODEL, subqueries=True)


def test_hints_and_comments_go_but_literals_stay(db):
    hinted = "SELECT /*+ BROADCAST(c) */ c.name, '/*+ keep */' AS a, '-- keep' AS b, 'it\\'s /* not */' AS d /* one /* two */ */ FROM orders o -- tail\n JOIN customers c ON o.customer_id = c.customer_id LIMIT 1"
    df = guarded_sql(db, hinted, MODEL)
    row = df.first()
    assert (row.a, row.b, row.d) == ("/*+ keep */", "-- keep", "it's /* not */")
    assert "Hint" not in df._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize("sql", REJECTED)
def test_rejected(db, sql):
    with pytest.raises(PolicyError):
        guarded_sql(db, sql, MODEL)


def test_correlation_off_the_model_is_rejected(db):
    with pytest.raises(PolicyError):
        guarded_sql(db, "SELECT name FROM customers c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.order_id = c.customer_id)", MODEL, subqueries=True)


def test_parameters_scope_and_kinds(db):
    df = guarded_sql(db, "SELECT order_id FROM orders WHERE amount >= :low AND amount <= :high", MODEL, parameters={"low": 6, "high": 15})
    assert [r.order_id for r in df.collect()] == [1]
    with pytest.raises(PolicyError):
        guarded_sql(db, "SELECT order_id FROM orders WHERE amount >= :low", MODEL, parameters={"low": 1, "more": 2})
    assert guarded_sql(db, "SELECT order_id FROM orders WHERE amount >= ? AND name = '?'".replace(" AND name = '?'", " AND '?' = '?'"), MODEL, parameters=[15]).count() == 1
    for given in ([], [1, 2], None):
        with pytest.raises(PolicyError):
            guarded_sql(db, "SELECT order_id FROM orders WHERE amount >= ?", MODEL, parameters=given)
    with pytest.raises(PolicyError) as e:
        guarded_sql(db, "SELECT name FROM customers", MODEL, allowed={"orders"})
    assert error_kind(e.value) == "policy"
    with pytest.raises(Exception) as e:
        guarded_sql(db, "SELECT nothing FROM orders", MODEL)
    assert error_kind(e.value) == "schema"


def test_timeout(spark):
    with pytest.raises(TimeoutError):
        with_timeout(spark, lambda: spark.range(10**12).selectExpr("sum(id * 3 % 7)").collect(), 1.0)
    assert with_timeout(spark, lambda: spark.range(5).count(), 30) == 5


def test_model_checks_and_bridges():
    assert MODEL.bridge({"refunds", "customers"}) == {"refunds", "orders", "customers"}
    with pytest.raises(ModelError):
        MODEL.bridge({"refunds", "calendar"})
    with pytest.raises(ModelError):
        Model({"a": Table("a", ("k",), {"k": "int"})}, [Relation("a", "b", (("k", "k"),))]).check()
    with pytest.raises(ModelError):
        Model({"a": Table("a", (), {"k": "int"})}).check()
    with pytest.raises(ModelError):
        MODEL.check_published({})
