"""Canonical components: one fixture for each rule, small enough to read."""

from arborlens.operators import architecture

COMPONENTS = "key string, name string, kind string, technology string, tags array<string>, evidence array<string>"


def canonical(spark, components, edges):
    c = spark.createDataFrame([(k, name, kind, tech, tags, ev) for k, name, kind, tech, tags, ev in components], COMPONENTS)
    e = spark.createDataFrame(edges, "source string, target string")
    return {r["key"]: r["canonical"] for r in architecture.canonical(c, e).collect()}


def service(key, name, evidence=None, technology=None, kind="service"):
    return (key, name, kind, technology, [], [evidence] if evidence else [])


def changed(got):
    return {k: v for k, v in got.items() if k != v}


def test_a_generic_store_is_the_one_concrete_store_of_its_source(spark):
    stores = [service("component:front", "front"), service("component:back", "back"), ("datastore:redis", "redis", "datastore", "Redis", ["datastore:redis"], None), service("component:redis-cart", "redis-cart", technology="Redis"), service("component:redis-data", "redis-data", technology="Redis")]
    one = [("component:front", "datastore:redis"), ("component:front", "component:redis-cart"), ("component:back", "component:redis-data")]
    # Another source's concrete store of the family is no hindrance.
    assert changed(canonical(spark, stores, one)) == {"datastore:redis": "component:redis-cart"}
    assert changed(canonical(spark, stores, [*one, ("component:front", "component:redis-data")])) == {}
    assert changed(canonical(spark, stores, [("component:front", "component:redis-cart"), ("component:back", "component:redis-data")])) == {}


def test_names_with_role_words_are_one_service(spark):
    c = [service("component:frontend", "frontend", "deployable"), service("component:payment", "payment", "grpc.server"), service("component:paymentservice", "paymentservice", "deployable"), service("contract:paymentservice", "PaymentService", "service-contract", kind="interface"), service("component:paymentapi", "paymentAPI", "runtime-component"), service("component:paymentdb", "paymentDB", "runtime-component")]
    got = canonical(spark, c, [("component:frontend", "component:payment"), ("component:payment", "component:paymentdb")])
    assert {k for k, v in got.items() if v == "component:paymentservice"} == {"component:payment", "component:paymentservice", "contract:paymentservice", "component:paymentapi", "component:paymentdb"}
    assert got["component:frontend"] == "component:frontend"


def test_names_inside_other_names_stay_apart(spark):
    c = [service("component:paymentservice", "paymentservice", "deployable"), service("component:shipping-payment-proxy", "shipping-payment-proxy", "deployable")]
    assert changed(canonical(spark, c, [("component:paymentservice", "component:shipping-payment-proxy")])) == {}


def test_compact_spellings_meet_in_the_third_phase(spark):
    c = [service("component:product-catalog", "product-catalog", "grpc.server"), service("component:productcatalogservice", "productcatalogservice", "deployable"), service("contract:productcatalogservice", "ProductCatalogService", "service-contract", kind="interface")]
    assert set(canonical(spark, c, [("component:product-catalog", "component:none")]).values()) == {"component:productcatalogservice"}


def test_short_roots_need_evidence_on_both_sides_and_a_role_word(spark):
    edges = [("component:ad", "component:adservice")]
    strong = [service("component:ad", "ad", "grpc.server"), service("component:adservice", "adservice", "deployable")]
    assert changed(canonical(spark, strong, edges)) == {"component:ad": "component:adservice"}
    assert changed(canonical(spark, [service("component:ad", "ad"), strong[1]], edges)) == {}


def test_an_edge_joins_names_without_evidence_and_interfaces_stay_apart(spark):
    c = [service("component:cart", "cart"), service("component:cart-api", "cart api"), service("component:mail", "mail"), service("component:mail-api", "mail api"), service("component:x", "same"), service("contract:x", "Same", kind="interface"), service("external:x", "same", kind="external")]
    # An interface of another's slug shares its root too, but nothing joins them.
    assert changed(canonical(spark, c, [("component:cart-api", "component:cart")])) == {"component:cart-api": "component:cart", "external:x": "component:x"}


def test_rows_of_one_key_do_not_meet_each_other(spark):
    from pyspark.sql import functions as F

    two = [service("component:cart", "cart"), service("component:cart", "cart", "grpc.server"), service("component:cartservice", "cartservice"), service("component:cartservice", "cartservice", "deployable")]
    c = spark.createDataFrame([(k, name, kind, tech, tags, ev) for k, name, kind, tech, tags, ev in two], COMPONENTS).crossJoin(spark.range(2000)).drop("id")
    e = spark.createDataFrame([("component:x", "component:cart")], "source string, target string")
    got = architecture.canonical(c, e).groupBy("key", "canonical").agg(F.count("*").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == [("component:cart", "component:cartservice", 4000), ("component:cartservice", "component:cartservice", 4000)]
