import random

import pytest

from tillworks.operators import sales, stock

CASES = [  # seq, lines, accepted
    (1, [("A", 8)], True),
    (2, [("A", 3), ("B", 1)], False),
    (3, [("B", 5)], True),
    (4, [("A", 2)], True),
    (5, [("A", 1)], False),
    (6, [("A", -4)], True),
    (7, [("A", 2), ("A", 3)], False),
]


def allocate(spark, transactions, opening, **options):
    rows = [(f"t{seq}", seq, p, q) for seq, lines in transactions for p, q in lines]
    demands = spark.createDataFrame(rows, "txn string, seq long, product_id string, quantity long")
    stocks = spark.createDataFrame(list(opening.items()), "product_id string, stock long")
    out = stock.allocate_stock(demands, stocks, **options).collect()
    assert len(out) == len(transactions)
    return {int(r.txn[1:]): r.accepted for r in out}


def replay(transactions, opening):
    left, out = dict(opening), {}
    for seq, lines in sorted(transactions):
        need = {}
        for p, q in lines:
            need[p] = need.get(p, 0) + q
        out[seq] = all(q <= 0 or left.get(p, 0) >= q for p, q in need.items())
        if out[seq]:
            for p, q in need.items():
                left[p] = left.get(p, 0) - q
    return out


@pytest.mark.parametrize("options", [{}, {"block_lines": 1}, {"block_lines": 4}])
def test_allocation_cases(spark, options):
    got = allocate(spark, [(s, x) for s, x, _ in CASES], {"A": 10, "B": 5}, **options)
    assert got == {s: ok for s, _, ok in CASES}


@pytest.mark.parametrize("seed,options", [
    (1, {"block_lines": 40}), (2, {}), (3, {"block_lines": 150})])
def test_allocation_equals_replay(spark, seed, options):
    rnd = random.Random(seed)
    # product p0 is in a third of all lines
    names = [f"p{i}" for i in range(25)]
    transactions = []
    for seq in range(250):
        if rnd.random() < 0.1:
            lines = [(rnd.choice(names), -rnd.randint(1, 20))]
        else:
            lines = [("p0" if rnd.random() < 0.33 else rnd.choice(names), rnd.randint(1, 6))
                     for _ in range(rnd.randint(1, 4))]
        transactions.append((seq, lines))
    opening = {n: rnd.randint(0, 40) for n in names}
    opening["p0"] = 300
    assert allocate(spark, transactions, opening, **options) == replay(transactions, opening)


def test_long_chains_take_no_more_rounds_than_blocks(spark, monkeypatch):
    # sale i of a chain wants what sale i - 1 may have taken, so verdicts alternate along a chain
    chains, length = 50, 120
    transactions = [
        (i * chains + c, [(f"c{c}-{i}", 1), (f"c{c}-{i + 1}", 1)])
        for c in range(chains) for i in range(length)]
    opening = {f"c{c}-{i}": 1 for c in range(chains) for i in range(length + 1)}
    written = []

    def settle(df, label):
        written.append(label)
        return write(df, label)

    write = stock.settle
    monkeypatch.setattr(stock, "settle", settle)
    got = allocate(spark, transactions, opening, block_lines=3000)
    assert got == {seq: (seq // chains) % 2 == 0 for seq, _ in transactions}
    assert 1 < written.count("alloc-round") <= 4


def test_blocks_do_not_make_tasks(spark, monkeypatch):
    # blocks of one line each: a few tasks follow them, and write a few files
    rnd = random.Random(5)
    transactions = [(seq, [(f"p{rnd.randrange(40)}", rnd.randint(1, 3)) for _ in range(2)])
                    for seq in range(300)]
    opening = {f"p{i}": 9 for i in range(40)}
    most = []

    def settle(df, label):
        done = write(df, label)
        if label in ("alloc-start", "alloc-round"):
            most.append(len(done.inputFiles()))
        return done

    write = stock.settle
    monkeypatch.setattr(stock, "settle", settle)
    got = allocate(spark, transactions, opening, block_lines=2)
    assert got == replay(transactions, opening)
    assert max(most) <= spark.sparkContext.defaultParallelism + 1


def move_all(moves, opening):
    left, out = dict(opening), []
    for seq, product, quantity, kind in sorted(moves):
        reason = None
        if quantity <= 0:
            reason = "bad_quantity"
        elif product not in left:
            reason = "product_not_found"
        elif kind == "entrada":
            left[product] += quantity
        elif kind != "salida":
            reason = "bad_kind"
        elif left[product] < quantity:
            reason = "insufficient_stock"
        else:
            left[product] -= quantity
        out.append((seq, reason, left.get(product)))
    return out, left


@pytest.mark.parametrize("slices,opening", [(30, 30), (7, 0), (None, 30)])
def test_movements_equal_replay(spark, make, now, slices, opening):
    rnd = random.Random(7)
    # product 0 holds a third of the movements, so it spans several slices
    moves = [
        (seq, 0 if rnd.random() < 0.34 else rnd.randint(1, 60), rnd.randint(0, 9),
         rnd.choice(["entrada", "salida", "salida", "salida", "otra"]))
        for seq in range(3000)]
    active = {p: rnd.randint(0, opening) for p in range(55)}
    products = make("products", [
        dict(id=p, product_name="x", retail_price=1, stock=active.get(p, 9), active=p in active)
        for p in range(60)])
    rows = spark.createDataFrame(moves, "seq long, product_id long, quantity long, kind string")
    applied = stock.apply_movements(products, rows, ["seq"], slices)
    want, left = move_all(moves, active)
    got = sorted((r.seq, r.reason, r.stock) for r in applied.collect())
    assert got == want
    table = {r.id: r for r in stock.stock_after(products, applied, ["seq"], now).collect()}
    assert {p: table[p].stock for p in left} == left
    assert all(r.stock >= 0 for r in table.values())
    moved = {m[1] for m, w in zip(sorted(moves), want) if w[1] is None}
    assert {p for p, r in table.items() if r.modified_at} == moved


def written_as(monkeypatch):
    labels = []

    def settle(df, label):
        labels.append(label)
        return write(df, label)

    write = stock.settle
    monkeypatch.setattr(stock, "settle", settle)
    return labels


def test_a_product_that_never_runs_out_is_followed_once(spark, make, monkeypatch):
    rnd = random.Random(8)
    moves = [(seq, 1, rnd.randint(1, 9), rnd.choice(["entrada", "salida"])) for seq in range(2000)]
    products = make("products", [
        dict(id=1, product_name="x", retail_price=1, stock=100_000, active=True)])
    rows = spark.createDataFrame(moves, "seq long, product_id long, quantity long, kind string")
    labels = written_as(monkeypatch)
    got = sorted(
        (r.seq, r.reason, r.stock)
        for r in stock.apply_movements(products, rows, ["seq"], slices=40).collect())
    assert got == move_all(moves, {1: 100_000})[0]
    assert labels == ["movements"]


def test_only_slices_out_of_bounds_are_followed_again(spark, make, monkeypatch):
    # out-movements use the stock up in the first slices; later slices see another stock than assumed
    moves = [(seq, 1, 1, "salida" if seq < 500 or seq % 2 else "entrada") for seq in range(1200)]
    products = make("products", [
        dict(id=1, product_name="x", retail_price=1, stock=300, active=True)])
    rows = spark.createDataFrame(moves, "seq long, product_id long, quantity long, kind string")
    labels = written_as(monkeypatch)
    got = sorted(
        (r.seq, r.reason, r.stock)
        for r in stock.apply_movements(products, rows, ["seq"], slices=24).collect())
    assert got == move_all(moves, {1: 300})[0]
    assert 2 <= len(labels) <= 4


@pytest.mark.parametrize("slices", [1, 20])
def test_deliveries_are_running_sums(spark, make, slices):
    rnd = random.Random(9)
    moves = [(seq, rnd.choice([0, 0, 1, 2, 9, None]), rnd.choice([0, -1, None, 1, 5, 7]))
             for seq in range(600)]
    products = make("products", [
        dict(id=p, product_name="x", retail_price=1, stock=p * 10, active=p != 2)
        for p in range(4)])
    rows = spark.createDataFrame(moves, "seq long, product_id long, quantity long")
    done = stock.stock_in(products, rows, ["seq"], slices)
    left, want = {0: 0, 1: 10, 3: 30}, []
    for seq, product, quantity in moves:
        bad = quantity is None or quantity <= 0
        if product in left and not bad:
            left[product] += quantity
        reason = "bad_quantity" if bad else None if product in left else "product_not_found"
        want.append((seq, reason, left.get(product)))
    assert sorted((r.seq, r.reason, r.stock) for r in done.collect()) == want
    plan = done._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert {r.kind for r in done.collect()} == {"entrada"}


def test_manual_adjustments(spark, shop):
    rows = spark.createDataFrame(
        [(1, 10, 5, "roto"), (2, 10, 16, "x"), (3, 10, 1, None), (4, 10, 1, ""), (5, 10, 0, "x"),
         (6, 99, 1, "x"), (7, 13, 1, "x")], "seq long, product_id long, quantity long, notes string")
    out = {r.seq: (r.reason, r.stock, r.notes)
           for r in stock.stock_out_adjustment(shop["products"], rows, ["seq"]).collect()}
    assert out[1] == (None, 15, "AJUSTE MANUAL: roto")
    assert out[2][:2] == ("insufficient_stock", 15)
    assert out[3][0] == out[4][0] == "note_required"
    assert out[5][0] == "bad_quantity"
    assert out[6][0] == out[7][0] == "product_not_found"


def new_sale(seq, total=10, tendered=None, paid="efectivo", user=1, status=None):
    return (seq, f"s{seq}", user, None, None, total, tendered, paid, status, None)


SALE = ("seq long, sale_ref string, user_id long, client_name string, client_ident string, "
        "total decimal(18,2), tendered string, payment_type string, status string, notes string")
LINE = "sale_ref string, position int, product_id long, quantity long, unit_price decimal(18,2)"


def frames(spark, sale_rows, line_rows):
    from decimal import Decimal

    sales_df = spark.createDataFrame(
        [(*r[:5], Decimal(r[5]), *r[6:]) for r in sale_rows], SALE)
    lines_df = spark.createDataFrame(
        [(f"s{s}", i, p, q, Decimal(5)) for s, i, p, q in line_rows], LINE)
    return sales_df, lines_df


def test_validation_order(spark, shop):
    grants = spark.createDataFrame([(1, sales.SELL)], "user_id long, permission string")
    sale_rows = [
        new_sale(1), new_sale(2, user=3), new_sale(3), new_sale(4, tendered="5"),
        new_sale(5, tendered="x"), new_sale(6, paid="vale"), new_sale(7, status="rara"),
        new_sale(8, tendered="5"), new_sale(9), new_sale(10)]
    line_rows = [
        (1, 1, 10, 2), (2, 1, 13, 1), (4, 1, 10, 1), (5, 1, 10, 1), (6, 1, 10, 1), (7, 1, 10, 1),
        (8, 1, 10, 1), (8, 2, 11, 99), (8, 3, 99, 1), (9, 1, 13, 1), (10, 1, 10, 0)]
    checked = sales.validate_sales(*frames(spark, sale_rows, line_rows), shop["products"], grants)
    assert {r.seq: r.reason for r in checked.collect()} == {
        1: None, 2: "no_permission", 3: "empty_cart", 4: "short_cash", 5: "bad_tender",
        6: "bad_payment_type", 7: "bad_status", 8: "insufficient_stock", 9: "product_not_found",
        10: "bad_quantity"}


def test_posting(spark, shop, now):
    grants = spark.createDataFrame([(1, sales.SELL)], "user_id long, permission string")
    sale_rows = [new_sale(1, tendered="12.50", paid=None), new_sale(2), new_sale(3), new_sale(4),
                 new_sale(5, tendered="1")]
    # sale 2 takes two lines that fit one by one but not together; sale 3 gets what it wanted
    line_rows = [(1, 1, 10, 8), (2, 1, 10, 7), (2, 2, 10, 7), (3, 1, 10, 12), (3, 2, 11, 4),
                 (4, 1, 11, 1), (5, 1, 10, 1)]
    done = sales.post_sales(*frames(spark, sale_rows, line_rows), shop["products"], grants,
                            shop["sales"], shop["sale_lines"], now)
    posted = sorted(done.sales.collect(), key=lambda r: r.id)
    assert len(posted) == 2 and posted[0].id > 6
    assert (posted[0].payment_type, float(posted[0].change_due)) == ("efectivo", 2.5)
    assert posted[0].status == "completada" and posted[1].change_due is None
    assert {r.seq: r.reason for r in done.refused.collect()} == {
        2: "insufficient_stock", 4: "insufficient_stock", 5: "short_cash"}
    lines = done.lines.collect()
    assert sorted((r.product_id, r.quantity) for r in lines) == [(10, 8), (10, 12), (11, 4)]
    assert {r.sale_id for r in lines} == {r.id for r in posted}
    assert len({r.id for r in lines}) == 3 and min(r.id for r in lines) > 6
    left = {r.id: (r.stock, r.modified_at is not None) for r in done.products.collect()}
    assert left == {10: (0, True), 11: (0, True), 12: (0, False), 13: (50, False)}
    assert done.sales.columns == shop["sales"].columns
    assert done.lines.columns == shop["sale_lines"].columns


def test_posting_equals_replay(spark, make, now, small_slices):
    rnd = random.Random(11)
    sale_rows = [new_sale(s) for s in range(300)]
    line_rows = [(s, i, 0 if rnd.random() < 0.33 else rnd.randint(1, 20), rnd.randint(1, 5))
                 for s in range(300) for i in range(rnd.randint(1, 4))]
    opening = {p: rnd.randint(5, 30) for p in range(21)}
    products = make("products", [
        dict(id=p, product_name="x", retail_price=1, stock=q, active=True)
        for p, q in opening.items()])
    grants = spark.createDataFrame([(1, sales.SELL)], "user_id long, permission string")
    done = sales.post_sales(*frames(spark, sale_rows, line_rows), products, grants,
                            make("sales", []), make("sale_lines", []), now,
                            block_lines=200)
    transactions = [
        (s, [(p, q) for t, _, p, q in line_rows if t == s]) for s in range(300)]
    want = replay(transactions, opening)
    assert {r.seq for r in done.refused.collect()} == {s for s, ok in want.items() if not ok}
    left = dict(opening)
    for s, lines in transactions:
        if want[s]:
            for p, q in lines:
                left[p] -= q
    assert {r.id: r.stock for r in done.products.collect()} == left


def fold_carts(events, products):
    carts = {}
    for seq, cart, product, kind, n in sorted(events):
        p, line = products[product], carts.get((cart, product))

        def tier(q):
            low = p["min"] and q >= p["min"] and p["wholesale"] is not None
            return p["wholesale"] if low else p["retail"]

        if kind == "add" and n > 0:
            carts[cart, product] = (line[0] + n, line[1]) if line else (n, tier(n))
        elif kind == "remove":
            carts.pop((cart, product), None)
        elif kind == "step" and line:
            if line[0] + n <= 0:
                del carts[cart, product]
            else:
                carts[cart, product] = (line[0] + n, tier(line[0] + n) if p["active"] else line[1])
    return carts


def test_cart_fold_equals_replay(spark, make, small_slices):
    rnd = random.Random(5)
    products = {
        p: dict(retail=10.25 + p, wholesale=rnd.choice([None, 8.5]), min=rnd.choice([None, 0, 3]),
                active=p % 3 != 0) for p in range(5)}
    events = []
    for seq in range(1500):
        kind = rnd.choice(["add", "step", "step", "step", "remove"])
        n = rnd.randint(0, 4) if kind == "add" else rnd.choice([-1, 1])
        # one line holds a third of all events
        cart, product = (0, 1) if rnd.random() < 0.33 else (rnd.randint(0, 6), rnd.randint(0, 4))
        events.append((seq, cart, product, kind, n))
    rows = spark.createDataFrame(
        events, "seq long, cart_id long, product_id long, kind string, quantity long")
    table = make("products", [
        dict(id=k, product_name="x", retail_price=v["retail"], wholesale_price=v["wholesale"],
             wholesale_min_qty=v["min"], stock=1, active=v["active"])
        for k, v in products.items()])
    out = sales.fold_cart_events(rows, table).collect()
    got = {(r.cart_id, r.product_id): (r.quantity, float(r.unit_price)) for r in out}
    assert got == fold_carts(events, products)
    assert all(r.line_subtotal == r.quantity * r.unit_price for r in out)


def test_price_lines_and_totals(spark, shop):
    lines = spark.createDataFrame(
        [(1, 10, 6), (1, 11, 2), (2, 10, 1), (3, 13, 1)],
        "cart_id long, product_id long, quantity long")
    totals = sales.cart_totals(sales.price_lines(lines, shop["products"])).collect()
    assert {r.cart_id: float(r.total) for r in totals} == {1: 163.0, 2: 25.0}
