"""The registered queries in DuckDB SQL, written against the order tables on their own terms.

Where the library avoids a join, a window or a self join, the SQL here uses it, so that both
ways of computing a result check each other.
"""

from __future__ import annotations

# Fixed values, written out here once more so that a wrong one in the library shows.
SCORE_CODES = {
    "Champions": ["555", "554", "544", "545", "454", "455", "445"],
    "Loyal Customers": ["543", "444", "435", "355", "354", "345", "344", "335"],
    "New Customers": ["512", "511", "422", "421", "412", "411", "311"],
    "At Risk": ["155", "154", "144", "214", "215", "115", "114"],
    "Cannot Lose Them": [
        "155", "254", "245", "253", "252", "243", "242", "235", "234", "225",
        "224", "153", "152", "145", "143", "142", "135", "134", "125", "124",
    ],
    "Price Sensitive": ["331", "321", "231", "241", "251"],
}
OTHER_CODES = "Others"
SEGMENT_REFERENCE = (
    ("Champions", "Bought recently, buy often, spend the most", "Reward them. Early access. Ask for reviews.", 1, "#10b981"),
    ("Loyal Customers", "Buy regularly with solid frequency", "Upsell. Loyalty programme. Referral asks.", 2, "#3b82f6"),
    ("Potential Loyalists", "Recent buyers with low frequency — room to grow", "Membership offers. Personalised recommendations.", 3, "#6366f1"),
    ("At Risk", "Were good customers, now going cold", "Win-back email. Renewal discount.", 4, "#f59e0b"),
    ("Hibernating", "Low recency and low frequency — gone quiet", "Reactivation campaign. Low-cost channel.", 5, "#94a3b8"),
    ("Lost", "Have not bought in a very long time", "Ignore or very cheap re-engagement only.", 6, "#475569"),
    ("New Customers", "Very recent, only 1-2 orders so far", "Onboarding flow. First-purchase follow-up.", 7, "#8b5cf6"),
    ("Promising", "Recent-ish buyers with some frequency", "Brand awareness. Free trials or samples.", 8, "#a78bfa"),
    ("Cannot Lose Them", "High historical value but have disappeared", "Personal outreach. Special offer. ASAP.", 9, "#ef4444"),
)
UPGRADE_PATHS = {
    "Potential Loyalists": "One more order → Loyal Customer",
    "Promising": "Two more orders → Potential Loyalist",
    "At Risk": "Recent purchase → Loyal Customer",
    "Hibernating": "Any purchase → Promising/New Customer",
    "New Customers": "Second purchase → Potential Loyalist",
}
NO_UPGRADE = "Already in top segment"

HOME = "'NATION_2'"


def text(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def rnd(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38,{digits + 4})), {digits}) AS DOUBLE)"


def div(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"


def pct(part: str, whole: str, digits: int) -> str:
    return rnd(f"(CAST({part} AS DOUBLE) * 100 / nullif(CAST({whole} AS DOUBLE), 0))", digits)


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def days(earlier: str, later: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) // 86400000000)"


def label(index: str) -> str:
    return f"printf('%04d-%02d', ({index} - 1) // 12, ({index} - 1) % 12 + 1)"


def ladder(value: str, steps: list[tuple[str, float]], otherwise: str, sign: str = ">=") -> str:
    whens = " ".join(f"WHEN {value} {sign} {bound} THEN {text(name)}" for name, bound in steps)
    return f"CASE {whens} ELSE {text(otherwise)} END"


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
PIECES = "CAST(l_quantity AS BIGINT)"
UNIT_PRICE = f"CAST(((2 * {CENTS} + {PIECES}) // (2 * {PIECES})) / 100.0 AS DECIMAL(12,2))"

# Common table expressions in the order they may build on one another.
CTES: dict[str, str] = {
    "sales": f"""
        SELECT l_orderkey AS InvoiceNo, l_partkey AS StockCode, p_name AS Description,
               p_brand AS Brand, p_type AS Kind, {PIECES} AS Quantity, o_orderdate AS InvoiceDate,
               {UNIT_PRICE} AS UnitPrice, o_custkey AS CustomerID, n_name AS Country,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS TotalAmount,
               CAST({PIECES} * {UNIT_PRICE} AS DECIMAL(12,2)) AS Revenue,
               year(o_orderdate) * 12 + month(o_orderdate) AS m,
               strftime(o_orderdate, '%Y-%m') AS yearmonth
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN part ON l_partkey = p_partkey""",
    "raw": f"""
        SELECT CASE WHEN o_orderstatus = 'P' THEN 'C' ELSE '' END || o_orderkey AS InvoiceNo,
               l_partkey AS StockCode, p_name AS Description, n_name AS Country,
               CASE WHEN l_returnflag = 'R' THEN -{PIECES} ELSE {PIECES} END AS Quantity,
               {UNIT_PRICE} AS UnitPrice, o_custkey AS CustomerID, o_orderdate AS InvoiceDate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
        LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "cust": """
        SELECT CustomerID, max(InvoiceDate) AS LastPurchaseDate,
               count(DISTINCT InvoiceNo) AS Frequency, sum(TotalAmount) AS Monetary,
               count(*) AS Lines
        FROM sales GROUP BY CustomerID""",
    "revcust": """
        SELECT CustomerID, max(InvoiceDate) AS LastPurchaseDate,
               count(DISTINCT InvoiceNo) AS Frequency, sum(Revenue) AS Monetary,
               count(*) AS Lines
        FROM sales GROUP BY CustomerID""",
}


def _scored(source: str) -> dict[str, str]:
    """Recency and scores; recency and spend by interpolated quantiles, frequency by row number."""
    snapshot = f"(SELECT max(LastPurchaseDate) + INTERVAL 1 DAY FROM {source})"

    def above(value: str, edges: str) -> str:
        return " + ".join(f"CAST({value} > {edges}[{i}] AS INTEGER)" for i in range(1, 5))

    bins = " + ".join(f"CAST(5 * rank0 > (n - 1) * {k} AS INTEGER)" for k in range(1, 5))
    return {
        f"{source}_base": f"SELECT *, {days('LastPurchaseDate', snapshot)} AS Recency FROM {source}",
        f"{source}_edges": f"""
            SELECT quantile_cont(Recency, [0.2, 0.4, 0.6, 0.8]) AS re,
                   quantile_cont(CAST(Monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS me,
                   count(*) AS n
            FROM {source}_base""",
        f"{source}_ranked": f"""
            SELECT b.*, re, me, n,
                   row_number() OVER (ORDER BY Frequency, CustomerID) - 1 AS rank0
            FROM {source}_base b, {source}_edges""",
        f"{source}_scored": f"""
            SELECT *, R_Score || '' || F_Score || '' || M_Score AS RFM_Score,
                   R_Score + F_Score + M_Score AS RFM_Total
            FROM (SELECT *, 5 - ({above('Recency', 're')}) AS R_Score,
                         1 + {bins} AS F_Score,
                         1 + {above('CAST(Monetary AS DOUBLE)', 'me')} AS M_Score
                  FROM {source}_ranked)""",
    }


CTES |= _scored("cust") | _scored("revcust")
CTES |= {
    # only the labels the rules can reach, each by what is left at that point
    "seg": """
        SELECT *, CASE WHEN R_Score >= 4 AND F_Score >= 4 THEN 'Champions'
                       WHEN R_Score >= 2 AND F_Score >= 3 THEN 'Loyal Customers'
                       WHEN R_Score >= 3 THEN 'Potential Loyalists'
                       WHEN F_Score <= 2 THEN 'Hibernating'
                       WHEN M_Score >= 3 THEN 'At Risk'
                       ELSE 'Lost' END AS Segment
        FROM cust_scored""",
    "ref": "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(v if isinstance(v, str) else str(v) for v in map(lambda x: text(x) if isinstance(x, str) else x, row)) + ")" for row in SEGMENT_REFERENCE)
    + ") t(segment, description, marketingaction, priority, colorhex)",
    "dimc": f"""
        SELECT CustomerID AS customerid, Recency AS recency, Frequency AS frequency,
               Monetary AS monetary, R_Score AS r_score, F_Score AS f_score, M_Score AS m_score,
               RFM_Total AS rfm_total, RFM_Score AS rfm_score, Segment AS segment,
               CAST(LastPurchaseDate AS DATE) AS lastpurchasedate,
               {rnd(div('Monetary', 'Frequency'), 2)} AS avgordervalue, Lines AS lines
        FROM seg""",
    "prodraw": """
        SELECT StockCode AS stockcode,
               arg_min(Description, (InvoiceDate, Description)) AS description,
               sum(UnitPrice) AS price, count(UnitPrice) AS prices,
               sum(Quantity) AS qty, sum(TotalAmount) AS revenue,
               count(DISTINCT CustomerID) AS buyers, count(DISTINCT InvoiceNo) AS invoices
        FROM sales GROUP BY StockCode""",
    "dimp": f"""
        SELECT stockcode, description, {rnd(div('price', 'prices'), 2)} AS avgunitprice,
               {big('qty')} AS totalquantitysold, revenue AS totalrevenue,
               buyers AS uniquecustomers, invoices AS uniqueinvoices,
               {rnd(div('buyers', '(SELECT max(buyers) FROM prodraw)'), 4)} AS popularityscore
        FROM prodraw""",
    "dimd": """
        SELECT DISTINCT CAST(InvoiceDate AS DATE) AS datekey, year(InvoiceDate) AS year,
               month(InvoiceDate) AS month, monthname(InvoiceDate) AS monthname,
               quarter(InvoiceDate) AS quarter, 'Q' || quarter(InvoiceDate) AS quartername,
               day(InvoiceDate) AS day, isodow(InvoiceDate) - 1 AS dayofweek,
               dayname(InvoiceDate) AS dayname,
               CASE WHEN isodow(InvoiceDate) >= 6 THEN 1 ELSE 0 END AS isweekend,
               strftime(InvoiceDate, '%Y-%m') AS yearmonth,
               year(InvoiceDate) || '-Q' || quarter(InvoiceDate) AS yearquarter
        FROM sales""",
    "geo": """
        SELECT Country AS country, sum(TotalAmount) AS totalrevenue,
               count(DISTINCT InvoiceNo) AS totalorders,
               count(DISTINCT CustomerID) AS uniquecustomers
        FROM sales GROUP BY Country""",
    "dimg": f"""
        SELECT country, CASE WHEN country = {HOME} THEN 1 ELSE 0 END AS isuk, totalrevenue,
               totalorders, uniquecustomers,
               {rnd(div('totalrevenue', 'totalorders'), 2)} AS avgordervalue,
               dense_rank() OVER (ORDER BY totalrevenue DESC) AS revenuerank
        FROM geo""",
    "fact": """
        SELECT CustomerID AS customerid, StockCode AS stockcode, CAST(InvoiceDate AS DATE) AS datekey,
               Country AS country, InvoiceNo AS invoiceno, InvoiceDate AS invoicedate,
               Quantity AS quantity, UnitPrice AS unitprice, TotalAmount AS totalamount,
               year(InvoiceDate) AS year, month(InvoiceDate) AS month,
               quarter(InvoiceDate) AS quarter, isodow(InvoiceDate) - 1 AS dayofweek,
               CASE WHEN isodow(InvoiceDate) >= 6 THEN 1 ELSE 0 END AS isweekend, yearmonth
        FROM sales""",
    "coh": "SELECT *, min(m) OVER (PARTITION BY CustomerID) AS cm FROM sales",
    "cells": """
        SELECT cm, m - cm AS idx, count(DISTINCT CustomerID) AS customers,
               sum(TotalAmount) AS revenue
        FROM coh GROUP BY cm, m - cm""",
    "ret": f"""
        SELECT {label('c.cm')} AS cohort, c.idx, c.customers, c.revenue,
               c.customers / CAST(z.customers AS DOUBLE) * 100 AS retention,
               {rnd(div('c.revenue', 'c.customers'), 2)} AS avgrevenue
        FROM cells c JOIN cells z ON c.cm = z.cm AND z.idx = 0""",
    "cosum_raw": """
        SELECT cohort, max(customers) FILTER (idx = 0) AS size, max(retention) FILTER (idx = 1) AS m1,
               max(retention) FILTER (idx = 3) AS m3, max(retention) FILTER (idx = 6) AS m6
        FROM ret GROUP BY cohort""",
    "cosum": f"""
        SELECT cohort AS "CohortMonth", size AS "CohortSize", {rnd('m1', 1)} AS "M1_Retention_%",
               {rnd('m3', 1)} AS "M3_Retention_%", {rnd('m6', 1)} AS "M6_Retention_%",
               CASE WHEN m1 IS NULL THEN 'Insufficient data' WHEN m1 >= 30 THEN 'Strong'
                    WHEN m1 >= 15 THEN 'Average' ELSE 'Weak' END AS "CohortQuality"
        FROM cosum_raw""",
}


def _level(p: str, size: int) -> str:
    """Sets of ``size`` items, by joining the baskets with themselves."""
    names = [f"t{i}" for i in range(size)]
    joins = " ".join(
        f"JOIN {p}_b {right} ON t0.InvoiceNo = {right}.InvoiceNo AND {left}.item < {right}.item"
        for left, right in zip(names, names[1:], strict=False)
    )
    items = ", ".join(f"{t}.item" for t in names)
    return f"""
            SELECT [{items}] AS items, count(*) AS c FROM {p}_b t0 {joins}
            GROUP BY {items} HAVING count(*) >= (SELECT least FROM {p}_n)"""


def _mining(
    name: str, item: str, where: str, top: int, support: float, longest: int = 3, confidence: float = 0.05, lift: float = 1.0
) -> dict[str, str]:
    """Baskets, itemsets by self joins, and rules from all splits, of one configuration."""
    p = name
    levels = range(1, longest + 1)
    return {
        f"{p}_items": f"SELECT DISTINCT InvoiceNo, upper(trim({item})) AS item FROM sales WHERE {where}",
        f"{p}_top": f"""
            SELECT item FROM {p}_items GROUP BY item ORDER BY count(*) DESC, item LIMIT {top}""",
        f"{p}_kept": f"SELECT * FROM {p}_items WHERE item IN (SELECT item FROM {p}_top)",
        f"{p}_b": f"""
            SELECT * FROM {p}_kept WHERE InvoiceNo IN
                (SELECT InvoiceNo FROM {p}_kept GROUP BY InvoiceNo HAVING count(*) >= 2)""",
        f"{p}_n": f"""
            SELECT count(DISTINCT InvoiceNo) AS n,
                   ceil(CAST({support} AS DOUBLE) * count(DISTINCT InvoiceNo)) AS least FROM {p}_b""",
        **{f"{p}_{size}": _level(p, size) for size in levels},
        f"{p}_sets": f"""
            SELECT items, c, c / CAST((SELECT n FROM {p}_n) AS DOUBLE) AS support
            FROM ({" UNION ALL ".join(f"SELECT * FROM {p}_{size}" for size in levels)})""",
        f"{p}_splits": f"""
            SELECT items, support, mask,
                   [items[i] for i in range(1, len(items) + 1) if (mask >> (i - 1)) & 1 = 1] AS a,
                   [items[i] for i in range(1, len(items) + 1) if (mask >> (i - 1)) & 1 = 0] AS b
            FROM (SELECT items, support,
                         unnest(range(1, CAST(pow(2, len(items)) - 1 AS BIGINT))) AS mask
                  FROM {p}_sets WHERE len(items) >= 2)""",
        f"{p}_measured": f"""
            SELECT s.a, s.b, s.support AS sup, x.support AS sa, y.support AS sb,
                   s.support / x.support AS conf, s.support / x.support / y.support AS lft
            FROM {p}_splits s JOIN {p}_sets x ON s.a = x.items JOIN {p}_sets y ON s.b = y.items""",
        f"{p}_rules": f"""
            SELECT array_to_string(a, ', ') AS antecedents_str,
                   array_to_string(b, ', ') AS consequents_str,
                   array_to_string(a, ', ') || '  →  ' || array_to_string(b, ', ') AS rule_str,
                   {rnd('sup', 4)} AS support, {rnd('conf', 4)} AS confidence, {rnd('lft', 4)} AS lift,
                   {rnd('sup - sa * sb', 4)} AS leverage,
                   CASE WHEN conf >= 1 THEN CAST('Infinity' AS DOUBLE)
                        ELSE {rnd('(1 - sb) / nullif(1 - conf, 0)', 4)} END AS conviction,
                   {ladder('lft', [('Very Strong', 5), ('Strong', 3), ('Moderate', 2)], 'Weak')} AS strength,
                   len(a) AS na, len(b) AS nb
            FROM {p}_measured WHERE conf >= {confidence} AND lft >= {lift}""",
    }


CTES |= _mining("name", "Description", "Description IS NOT NULL", 50, 0.005)
CTES |= _mining("kind", "Kind", "Kind IS NOT NULL", 1_000_000, 0.02, 5, 0.2, 0.5)
CTES |= _mining("brand", "Brand", f"Brand IS NOT NULL AND Country = {HOME}", 20, 0.02)
CTES |= {
    "pairs": """
        SELECT antecedents_str, consequents_str, rule_str, support, confidence, lift, strength
        FROM name_rules WHERE na = 1 AND nb = 1
        ORDER BY lift DESC, antecedents_str, consequents_str LIMIT 20""",
    "net": """
        SELECT CASE WHEN length(antecedents_str) > 20 THEN substr(antecedents_str, 1, 20) || '…'
                    ELSE antecedents_str END AS source,
               CASE WHEN length(consequents_str) > 20 THEN substr(consequents_str, 1, 20) || '…'
                    ELSE consequents_str END AS target,
               greatest(1.0::DOUBLE, confidence * 6) AS weight, strength
        FROM (SELECT * FROM pairs ORDER BY lift DESC, antecedents_str, consequents_str LIMIT 12)""",
    "custstat": f"""
        SELECT CustomerID, count(DISTINCT InvoiceNo) AS TotalOrders,
               {big('sum(Quantity)')} AS TotalItems, sum(Revenue) AS spend,
               min(InvoiceDate) AS f, max(InvoiceDate) AS l
        FROM sales GROUP BY CustomerID""",
    "custfeat": f"""
        SELECT CustomerID, TotalOrders, TotalItems, {dbl('spend')} AS TotalSpend,
               {stamp('f')} AS FirstPurchase, {stamp('l')} AS LastPurchase,
               {days('f', 'l')} AS CustomerLifetimeDays,
               {div('spend', 'TotalOrders')} AS AvgOrderValue,
               {div('TotalItems', 'TotalOrders')} AS AvgItemsPerOrder
        FROM custstat""",
    "codes": f"""
        SELECT CustomerID, Recency, Frequency, {dbl('Monetary')} AS Monetary, R_Score, F_Score,
               M_Score, RFM_Score,
               CASE {" ".join(f"WHEN RFM_Score IN ({', '.join(map(text, codes))}) THEN {text(name)}" for name, codes in SCORE_CODES.items())}
                    ELSE {text(OTHER_CODES)} END AS CustomerSegment
        FROM revcust_scored""",
    "prodstat": """
        SELECT StockCode, sum(Quantity) AS q, sum(Revenue) AS r, count(DISTINCT CustomerID) AS c,
               count(DISTINCT InvoiceNo) AS i, sum(UnitPrice) AS p, count(UnitPrice) AS pn
        FROM sales GROUP BY StockCode""",
    "prodfeat": f"""
        SELECT StockCode, {big('q')} AS ProductTotalQty, {dbl('r')} AS ProductTotalRevenue,
               c AS ProductUniqueCustomers, i AS ProductTransactions,
               {div('p', 'pn')} AS AvgProductPrice,
               {div('c', '(SELECT max(c) FROM prodstat)')} AS ProductPopularity
        FROM prodstat""",
    "ordstat": """
        SELECT InvoiceNo, sum(Quantity) AS q, sum(Revenue) AS r, count(DISTINCT StockCode) AS b,
               min(CustomerID) AS CustomerID, min(InvoiceDate) AS d
        FROM sales GROUP BY InvoiceNo""",
    "ordfeat": f"""
        SELECT InvoiceNo, {big('q')} AS OrderTotalQty, {dbl('r')} AS OrderTotalRevenue,
               b AS BasketSize,
               {days('lag(d) OVER (PARTITION BY CustomerID ORDER BY d, InvoiceNo)', 'd')}
                   AS DaysSinceLastOrder
        FROM ordstat""",
    "freq": "SELECT Country, count(*) AS CountryFreq FROM sales GROUP BY Country",
    "months": "SELECT DISTINCT m, yearmonth, CustomerID FROM sales",
    "mom": """
        SELECT c.m, c.yearmonth, count(DISTINCT c.CustomerID) AS active,
               count(DISTINCT p.CustomerID) AS kept
        FROM months c LEFT JOIN months p ON c.CustomerID = p.CustomerID AND c.m = p.m + 1
        GROUP BY c.m, c.yearmonth""",
    "units": """
        SELECT yearmonth, TotalAmount AS amount,
               row_number() OVER (PARTITION BY CustomerID ORDER BY InvoiceDate, InvoiceNo, TotalAmount) AS rn
        FROM (SELECT DISTINCT CustomerID, InvoiceNo, yearmonth, TotalAmount, InvoiceDate FROM sales)""",
    "order_units": """
        SELECT yearmonth, amount,
               row_number() OVER (PARTITION BY CustomerID ORDER BY InvoiceDate, InvoiceNo) AS rn
        FROM (SELECT CustomerID, InvoiceNo, yearmonth, InvoiceDate, sum(TotalAmount) AS amount
              FROM sales GROUP BY ALL)""",
    "total": "SELECT sum(TotalAmount) AS t FROM sales",
}

_DATE_PARTS = """year(InvoiceDate) AS "Year", month(InvoiceDate) AS "Month", day(InvoiceDate) AS "Day",
    hour(InvoiceDate) AS "Hour", isodow(InvoiceDate) - 1 AS "DayOfWeek",
    CASE WHEN isodow(InvoiceDate) >= 6 THEN 1 ELSE 0 END AS "IsWeekend",
    quarter(InvoiceDate) AS "Quarter" """
_PRICE_BAND = """CASE WHEN UnitPrice <= 0 OR UnitPrice > 1000000 THEN NULL
    WHEN UnitPrice <= 1000 THEN 'Very Low' WHEN UnitPrice <= 5000 THEN 'Low'
    WHEN UnitPrice <= 10000 THEN 'Medium' WHEN UnitPrice <= 50000 THEN 'High' ELSE 'Premium' END"""
_LINE = f"InvoiceNo, StockCode, CustomerID, {stamp('InvoiceDate')} AS InvoiceDate, Quantity, {dbl('UnitPrice')} AS UnitPrice"
_ORDERS = "count(DISTINCT InvoiceNo)"
_BUYERS = "count(DISTINCT CustomerID)"
_SUM = "sum(TotalAmount)"


def _wide(value: str) -> str:
    cells = ", ".join(f'max({value}) FILTER (idx = {i}) AS "M{i}"' for i in range(84))
    return f'SELECT cohort AS "CohortMonth", {cells} FROM ret GROUP BY cohort'


def _split_report(units: str) -> str:
    return f"""
        SELECT yearmonth AS "Month",
               CASE WHEN rn = 1 THEN 'New Customer' ELSE 'Returning Customer' END AS "Customer_Type",
               count(*) AS "Orders", {rnd('sum(amount)', 0)} AS "Revenue_GBP",
               {pct('sum(amount)', 'sum(sum(amount)) OVER (PARTITION BY yearmonth)', 1)} AS "% of Month Revenue"
        FROM {units} GROUP BY 1, 2"""


def _overview(source: str) -> str:
    return f"""
        SELECT segment AS "Segment", count(DISTINCT customerid) AS "Customers",
               {pct('count(DISTINCT customerid)', 'sum(count(DISTINCT customerid)) OVER ()', 1)} AS "Customer_%",
               {rnd('sum(amount)', 0)} AS "Total_Revenue_GBP",
               {pct('sum(amount)', 'sum(sum(amount)) OVER ()', 1)} AS "Revenue_%",
               {rnd(div('sum(monetary)', 'count(*)'), 0)} AS "Avg_Lifetime_Spend",
               {rnd(div('sum(recency)', 'count(*)'), 0)} AS "Avg_Days_Since_Purchase",
               {rnd(div('sum(frequency)', 'count(*)'), 1)} AS "Avg_Orders",
               marketingaction AS "Recommended_Action"
        FROM {source} GROUP BY segment, marketingaction"""


def _growth(order: str) -> str:
    before = f"lag({_SUM}) OVER (ORDER BY {order})"
    return pct(f"({_SUM} - {before})", before, 1)


_RULE_COLUMNS = (
    "antecedents_str, consequents_str, rule_str, support, confidence, lift, leverage, conviction, strength"
)
_SUMMARY = f"""
    SELECT Segment AS "Segment", count(*) AS "Customers", {dbl('sum(Monetary)')} AS "Total_Revenue",
           {rnd(div('sum(Monetary)', 'count(*)'), 2)} AS "Avg_Revenue",
           {rnd('median(CAST(Monetary AS DECIMAL(18,3)))', 2)} AS "Median_Revenue",
           {rnd(div('sum(Recency)', 'count(*)'), 1)} AS "Avg_Recency_Days",
           {rnd(div('sum(Frequency)', 'count(*)'), 1)} AS "Avg_Frequency",
           {rnd(div('sum(RFM_Total)', 'count(*)'), 1)} AS "Avg_RFM_Score",
           {pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS "Customer_Share_%",
           {pct('sum(Monetary)', 'sum(sum(Monetary)) OVER ()', 1)} AS "Revenue_Share_%"
    FROM seg GROUP BY Segment"""
_ACTION = "(SELECT marketingaction FROM ref r WHERE r.segment = s.Segment)"
_DIMC = f"customerid, recency, frequency, {dbl('monetary')} AS monetary, r_score, f_score, m_score, rfm_total, rfm_score, segment, lastpurchasedate, avgordervalue, lines"
_ISO = "strftime(lastpurchasedate, '%Y-%m-%d')"

_SELECTS: dict[str, str] = {
    "load_sales_lines": f"SELECT {_LINE}, Description, Country, {dbl('TotalAmount')} AS TotalAmount FROM sales",
    "csv_round_trip": f"""
        SELECT yearmonth AS "Month", count(*) AS lines, count(DISTINCT InvoiceNo) AS orders,
               count(DISTINCT CustomerID) AS customers, {dbl('sum(Revenue)')} AS amount
        FROM sales GROUP BY yearmonth""",
    "csv_rejects": f"""
        WITH marked AS (
            SELECT *, InvoiceNo % 47 = 0 OR InvoiceNo % 53 = 0 AS shape, InvoiceNo % 37 = 0 AS bare,
                   InvoiceNo % 41 = 0 AS pieces, InvoiceNo % 43 = 0 AS day FROM sales)
        SELECT 'accepted' AS outcome, count(*) AS lines, {dbl('sum(Revenue)')} AS amount
        FROM marked WHERE NOT (shape OR bare OR pieces OR day)
        UNION ALL SELECT 'rejected', count(*), NULL FROM marked WHERE shape OR bare OR pieces OR day
        UNION ALL SELECT reason, count(*), NULL FROM (
            SELECT 'number of columns' AS reason FROM marked WHERE shape
            UNION ALL SELECT 'InvoiceNo: missing' FROM marked WHERE bare AND NOT shape
            UNION ALL SELECT 'Quantity: not int' FROM marked WHERE pieces AND NOT shape
            UNION ALL SELECT 'InvoiceDate: not timestamp_ntz' FROM marked WHERE day AND NOT shape)
        GROUP BY reason""",
    "clean_sales": f"""
        WITH ok AS (SELECT * FROM raw WHERE CustomerID IS NOT NULL AND InvoiceNo NOT LIKE 'C%'
                    AND Quantity > 0 AND UnitPrice > 0)
        SELECT {_LINE}, Description, Country, {dbl('CAST(Quantity * UnitPrice AS DECIMAL(12,2))')} AS TotalAmount,
               strftime(InvoiceDate, '%Y-%m') AS YearMonth
        FROM ok WHERE Quantity <= (SELECT quantile_cont(Quantity, 0.95) FROM ok)""",
    "quantity_outliers": f"""
        WITH e AS (SELECT quantile_cont(CAST(TotalAmount AS DOUBLE), 0.99) AS t FROM sales)
        SELECT count(*) AS lines, count(*) FILTER (CAST(TotalAmount AS DOUBLE) > t) AS outliers,
               {dbl('sum(TotalAmount) FILTER (CAST(TotalAmount AS DOUBLE) <= t)')} AS kept_amount,
               round(max(t), 4) AS threshold
        FROM sales, e""",
    "amount_quantiles": " UNION ALL ".join(
        f"""SELECT {f}::DOUBLE AS fraction, round(quantile_cont(CAST(TotalAmount AS DOUBLE), {f}), 4) AS exact,
                   {round(3 * 2.296 / 800**0.9021, 6)}::DOUBLE AS bound, TRUE AS holds FROM sales"""
        for f in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    ),
    "datetime_features": f"""
        SELECT InvoiceNo, StockCode, Quantity, {stamp('InvoiceDate')} AS InvoiceDate, {_DATE_PARTS} FROM sales""",
    "price_bands": f"""
        SELECT InvoiceNo, StockCode, Quantity, {dbl('UnitPrice')} AS UnitPrice, {dbl('Revenue')} AS Revenue,
               {_PRICE_BAND} AS PricePerUnit_Binned FROM sales""",
    "customer_features": f"SELECT {_LINE}, c.* EXCLUDE (CustomerID) FROM sales JOIN custfeat c USING (CustomerID)",
    "product_features": f"SELECT {_LINE}, p.* EXCLUDE (StockCode) FROM sales JOIN prodfeat p USING (StockCode)",
    "order_features": f"SELECT {_LINE}, o.* EXCLUDE (InvoiceNo) FROM sales JOIN ordfeat o USING (InvoiceNo)",
    "country_frequency": "SELECT * FROM freq",
    "rfm_code_segments": "SELECT * FROM codes",
    "engineered_sales": f"""
        SELECT {_LINE}, Country, {dbl('Revenue')} AS Revenue, {_PRICE_BAND} AS PricePerUnit_Binned,
               {_DATE_PARTS}, CASE WHEN Country = {HOME} THEN 1 ELSE 0 END AS IsUK, CountryFreq,
               c.* EXCLUDE (CustomerID), k.* EXCLUDE (CustomerID), p.* EXCLUDE (StockCode),
               o.* EXCLUDE (InvoiceNo)
        FROM sales JOIN custfeat c USING (CustomerID) JOIN codes k USING (CustomerID)
        JOIN prodfeat p USING (StockCode) JOIN ordfeat o USING (InvoiceNo) JOIN freq USING (Country)""",
    "rfm_base": f"""
        SELECT CustomerID, {stamp('LastPurchaseDate')} AS LastPurchaseDate, Frequency,
               {dbl('Monetary')} AS Monetary, Lines, Recency FROM cust_base""",
    "rfm_scores": f"""
        SELECT CustomerID, {stamp('LastPurchaseDate')} AS LastPurchaseDate, Frequency,
               {dbl('Monetary')} AS Monetary, Lines, Recency, R_Score, F_Score, M_Score, RFM_Score,
               RFM_Total FROM cust_scored""",
    "rfm_segments": f"""
        SELECT CustomerID, {stamp('LastPurchaseDate')} AS LastPurchaseDate, Frequency,
               {dbl('Monetary')} AS Monetary, Lines, Recency, R_Score, F_Score, M_Score, RFM_Score,
               RFM_Total, Segment, {_ACTION} AS Action FROM seg s""",
    "rfm_segment_distribution": f"""
        SELECT Segment, count(*) AS Customers, {pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS "Share_%"
        FROM seg GROUP BY Segment""",
    "rfm_segment_summary": _SUMMARY,
    "rfm_insights": f"""
        SELECT "Segment", "Customers", "Customer_Share_%", "Total_Revenue", "Revenue_Share_%", {_ACTION} AS "Action"
        FROM ({_SUMMARY}) s WHERE "Segment" IN ('Champions', 'At Risk', 'Cannot Lose Them')""",
    "rfm_score_balance": """
        SELECT 'R' AS metric, r_score AS score, count(*) AS customers FROM dimc GROUP BY r_score
        UNION ALL SELECT 'F', f_score, count(*) FROM dimc GROUP BY f_score
        UNION ALL SELECT 'M', m_score, count(*) FROM dimc GROUP BY m_score""",
    "cohort_assignments": f"""
        SELECT InvoiceNo, CustomerID, {stamp('InvoiceDate')} AS InvoiceDate, {dbl('TotalAmount')} AS TotalAmount,
               {label('m')} AS TransactionMonth, {label('cm')} AS CohortMonth, m - cm AS CohortIndex FROM coh""",
    "cohort_extent": 'SELECT count(DISTINCT cm) AS "Cohorts", max(idx) AS "MaxIndex" FROM cells',
    "cohort_counts": _wide("customers"),
    "cohort_retention_long": """
        SELECT cohort AS "CohortMonth", idx AS "CohortIndex", customers AS "Customers",
               retention AS "Retention" FROM ret""",
    "cohort_retention_matrix": _wide("retention"),
    "cohort_revenue_long": f"""
        SELECT cohort AS "CohortMonth", idx AS "CohortIndex", {dbl('revenue')} AS "TotalRevenue",
               customers AS "UniqueCustomers", avgrevenue AS "AvgRevenue" FROM ret""",
    "cohort_revenue_matrix": _wide("avgrevenue"),
    "cohort_summary": "SELECT * FROM cosum",
    "cohort_best_worst": f"""
        WITH k AS (SELECT * FROM cosum WHERE "M1_Retention_%" IS NOT NULL),
             b AS (SELECT * FROM k ORDER BY "M1_Retention_%" DESC, "CohortMonth" LIMIT 1),
             w AS (SELECT * FROM k ORDER BY "M1_Retention_%", "CohortMonth" LIMIT 1)
        SELECT b."CohortMonth" AS "Best_Cohort", b."M1_Retention_%" AS "Best_M1_%", b."CohortSize" AS "Best_Size",
               w."CohortMonth" AS "Worst_Cohort", w."M1_Retention_%" AS "Worst_M1_%", w."CohortSize" AS "Worst_Size",
               {rnd('(SELECT avg("M1_Retention_%") FROM cosum)', 1)} AS "Avg_M1_%",
               (SELECT count(*) FROM cosum WHERE "CohortQuality" = 'Strong') AS "Strong_Cohorts",
               (SELECT count(*) FROM cosum WHERE "CohortQuality" = 'Weak') AS "Weak_Cohorts"
        FROM b, w""",
    "basket_lines": """
        SELECT s.InvoiceNo, upper(trim(s.Brand)) AS Description, Quantity, Country
        FROM sales s JOIN brand_b k ON s.InvoiceNo = k.InvoiceNo AND upper(trim(s.Brand)) = k.item
        WHERE Country = """ + HOME,
    "baskets": """
        SELECT InvoiceNo, array_to_string(list_sort(list(item)), ', ') AS Items FROM name_b GROUP BY InvoiceNo""",
    "basket_density": f"""
        SELECT count(DISTINCT InvoiceNo) AS "Baskets", count(DISTINCT item) AS "Products", count(*) AS "Filled",
               {rnd('count(*) * 100.0::DOUBLE / (count(DISTINCT InvoiceNo) * count(DISTINCT item))', 4)} AS "Density_%"
        FROM name_b""",
    "frequent_itemsets": "SELECT array_to_string(items, ', ') AS itemset, len(items) AS length, c AS n, support FROM name_sets",
    "frequent_brand_itemsets": "SELECT array_to_string(items, ', ') AS itemset, len(items) AS length, c AS n, support FROM brand_sets",
    "association_rules": f"SELECT {_RULE_COLUMNS} FROM name_rules",
    "brand_association_rules": f"SELECT {_RULE_COLUMNS} FROM brand_rules",
    "long_itemsets": "SELECT array_to_string(items, ', ') AS itemset, len(items) AS length, c AS n, support FROM kind_sets",
    "long_association_rules": f"SELECT {_RULE_COLUMNS} FROM kind_rules",
    "rule_strength_counts": "SELECT strength, count(*) AS rules FROM name_rules GROUP BY strength",
    "top_product_pairs": "SELECT * FROM pairs",
    "rfm_segment_reference": """
        SELECT r.*, c.customers FROM ref r
        LEFT JOIN (SELECT segment, count(*) AS customers FROM dimc GROUP BY segment) c USING (segment)""",
    "dim_customers": f"SELECT {_DIMC} FROM dimc",
    "dim_products": f"SELECT * REPLACE ({dbl('totalrevenue')} AS totalrevenue) FROM dimp",
    "dim_date": "SELECT * FROM dimd",
    "dim_geography": f"SELECT * REPLACE ({dbl('totalrevenue')} AS totalrevenue) FROM dimg",
    "fact_transactions": f"""
        SELECT * REPLACE ({stamp('invoicedate')} AS invoicedate, {dbl('unitprice')} AS unitprice,
                          {dbl('totalamount')} AS totalamount) FROM fact""",
    "star_refreshed_twice": f"""
        SELECT year, month, lines, amount, version, days
        FROM (SELECT year, month, count(*) AS lines, {dbl('sum(totalamount)')} AS amount,
                     CASE WHEN year IN (1996, 1997) THEN 1 WHEN year = 1998 THEN 2 ELSE 3 END AS version
              FROM fact WHERE quantity <= 40 OR year NOT IN (1996, 1997) GROUP BY year, month)
        JOIN (SELECT year, month, count(*) AS days FROM dimd GROUP BY year, month) USING (year, month)""",
    "star_row_counts": """
        SELECT 'fact_transactions' AS tbl, count(*) AS rows FROM fact
        UNION ALL SELECT 'dim_customers', count(*) FROM dimc
        UNION ALL SELECT 'dim_products', count(*) FROM dimp
        UNION ALL SELECT 'dim_date', count(*) FROM dimd
        UNION ALL SELECT 'dim_geography', count(*) FROM dimg""",
    "dq_row_counts": """
        SELECT *, CASE WHEN rows >= expected THEN 1 ELSE 0 END AS ok FROM (
            SELECT 'fact_transactions' AS tbl, count(*) AS rows, 50000 AS expected FROM fact
            UNION ALL SELECT 'dim_customers', count(*), 1000 FROM dimc
            UNION ALL SELECT 'dim_products', count(*), 1500 FROM dimp
            UNION ALL SELECT 'dim_date', count(*), 2000 FROM dimd
            UNION ALL SELECT 'dim_geography', count(*), 30 FROM dimg)""",
    "dq_foreign_keys": " UNION ALL ".join(
        f"""SELECT '{key} -> {dim}' AS foreign_key, count(*) AS orphans FROM fact f
            WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {cte} d WHERE d.{key} = f.{key})"""
        for key, dim, cte in (
            ("customerid", "dim_customers", "dimc"),
            ("stockcode", "dim_products", "dimp"),
            ("datekey", "dim_date", "dimd"),
            ("country", "dim_geography", "dimg"),
        )
    ),
    "dq_primary_keys": " UNION ALL ".join(
        f"""SELECT '{dim}' AS tbl,
                   (SELECT count(*) FROM (SELECT {key} FROM {cte} GROUP BY {key} HAVING count(*) > 1)) AS duplicates,
                   (SELECT count(*) FROM {cte} WHERE {key} IS NULL) AS nulls"""
        for dim, key, cte in (
            ("dim_customers", "customerid", "dimc"),
            ("dim_products", "stockcode", "dimp"),
            ("dim_date", "datekey", "dimd"),
            ("dim_geography", "country", "dimg"),
            ("dim_rfm_segments", "segment", "ref"),
        )
    ),
    "dq_given_keys": " UNION ALL ".join(
        [
            f"SELECT '{t}' AS tbl, 'repeated' AS rule, count(*) AS \"values\", {big('coalesce(sum(n), 0)')} AS \"rows\" "
            f"FROM (SELECT count(*) AS n FROM {t} WHERE {' AND '.join(k + ' IS NOT NULL' for k in key)} GROUP BY {', '.join(key)} HAVING count(*) > 1) "
            f"UNION ALL SELECT '{t}', 'missing', count(*), {big('coalesce(sum(n), 0)')} "
            f"FROM (SELECT count(*) AS n FROM {t} WHERE {' OR '.join(k + ' IS NULL' for k in key)} GROUP BY {', '.join(key)})"
            for t, key in (
                ("lineitem", ("l_orderkey", "l_linenumber")), ("orders", ("o_orderkey",)),
                ("customer", ("c_custkey",)), ("part", ("p_partkey",)),
            )
        ]
        + [
            f"SELECT '{t}', '{c} unmatched', count(DISTINCT {c}), count({c}) FROM {t} "
            f"WHERE {c} NOT IN (SELECT {k} FROM {target})"
            for t, c, target, k in (
                ("lineitem", "l_orderkey", "orders", "o_orderkey"),
                ("lineitem", "l_partkey", "part", "p_partkey"),
                ("orders", "o_custkey", "customer", "c_custkey"),
            )
        ]
    ),
    "dq_checks": " UNION ALL ".join(
        [
            f"SELECT 'fact_transactions.{c} not null' AS rule, count(*) AS violations FROM fact WHERE {c} IS NULL"
            for c in ("invoiceno", "invoicedate", "quantity", "unitprice", "totalamount")
        ]
        + [
            f"SELECT 'dim_customers.{c} 1 to 5' AS rule, count(*) AS violations FROM dimc WHERE {c} NOT BETWEEN 1 AND 5"
            for c in ("r_score", "f_score", "m_score")
        ]
    ),
    "distinct_by_period": " UNION ALL ".join(
        f"""SELECT '{level}' AS level, {period} AS period, count(DISTINCT CustomerID) AS customers,
                   count(DISTINCT StockCode) AS products FROM sales GROUP BY {period}"""
        for level, period in (
            ("day", "strftime(InvoiceDate, '%Y-%m-%d')"),
            ("month", "yearmonth"),
            ("quarter", "year(InvoiceDate) || '-Q' || quarter(InvoiceDate)"),
            ("year", "strftime(InvoiceDate, '%Y')"),
            ("all", "'all'"),
        )
    ),
    "verify_segment_revenue": f"""
        SELECT c.segment, count(DISTINCT f.customerid) AS customers, {rnd('sum(f.totalamount)', 0)} AS total_revenue,
               {rnd(div('sum(f.totalamount)', 'count(*)'), 2)} AS avg_line_value
        FROM fact f JOIN dimc c ON f.customerid = c.customerid GROUP BY c.segment""",
    "verify_top_customers": f"""
        SELECT customerid, segment, {dbl('monetary')} AS monetary, frequency, r_score, f_score, m_score
        FROM dimc ORDER BY dimc.monetary DESC, customerid LIMIT 5""",
    "verify_top_countries": f"""
        SELECT country, {dbl('totalrevenue')} AS totalrevenue, totalorders, uniquecustomers, revenuerank
        FROM dimg ORDER BY revenuerank, country LIMIT 5""",
    "segment_overview": _overview(
        "(SELECT c.*, f.totalamount AS amount, r.marketingaction FROM dimc c JOIN fact f USING (customerid) JOIN ref r USING (segment))"
    ),
    "segment_overview_per_customer": _overview(
        "(SELECT c.*, c.monetary AS amount, r.marketingaction FROM dimc c JOIN ref r USING (segment))"
    ),
    "top_customers": f"""
        SELECT customerid AS "CustomerID", segment AS "Segment", {rnd('monetary', 2)} AS "Lifetime_Spend_GBP",
               frequency AS "Total_Orders", avgordervalue AS "Avg_Order_Value_GBP",
               recency AS "Days_Since_Last_Purchase", r_score AS "R_Score", f_score AS "F_Score",
               m_score AS "M_Score", rfm_total AS "RFM_Total", {_ISO} AS "Last_Purchase_Date",
               {ladder('recency', [('Active', 30), ('Cooling', 90), ('At Risk', 180)], 'Lapsed', '<=')} AS "Activity_Status"
        FROM dimc ORDER BY monetary DESC, customerid LIMIT 20""",
    "champions_deep_dive": f"""
        SELECT c.customerid, {rnd('c.monetary', 2)} AS lifetime_spend, c.frequency AS total_orders,
               c.avgordervalue AS avg_order_value, c.recency AS days_since_purchase,
               count(DISTINCT f.stockcode) AS unique_products_bought,
               count(DISTINCT f.yearmonth) AS active_months,
               {stamp('min(f.invoicedate)')} AS first_purchase, {stamp('max(f.invoicedate)')} AS last_purchase
        FROM dimc c JOIN fact f ON c.customerid = f.customerid WHERE c.segment = 'Champions'
        GROUP BY c.customerid, c.monetary, c.frequency, c.avgordervalue, c.recency""",
    "winback_list": f"""
        SELECT customerid AS "CustomerID", segment AS "Segment", {rnd('monetary', 2)} AS "Lifetime_Spend_GBP",
               frequency AS "Historical_Orders", recency AS "Days_Silent", avgordervalue AS "Avg_Order_Value_GBP",
               r_score AS "R_Score", m_score AS "M_Score", {_ISO} AS "Last_Seen",
               {rnd('avgordervalue * frequency', 0)} AS "Est_Annual_Revenue_At_Risk", marketingaction AS "Action"
        FROM dimc JOIN ref USING (segment) WHERE segment IN ('At Risk', 'Cannot Lose Them')""",
    "reactivation_list": f"""
        SELECT customerid, {rnd('monetary', 2)} AS lifetime_spend, frequency AS past_orders,
               recency AS days_inactive, avgordervalue AS avg_order_value,
               {ladder('monetary', [('High', 1500000), ('Medium', 1000000)], 'Low')} AS reactivation_tier,
               strftime(lastpurchasedate, '%d %b %Y') AS last_purchase
        FROM dimc WHERE segment = 'Hibernating'""",
    "nurture_pipeline": f"""
        SELECT customerid, segment, recency AS days_since_first_purchase, frequency AS orders_so_far,
               {rnd('monetary', 2)} AS spend_so_far, avgordervalue AS avg_order_value, {_ISO} AS last_purchase,
               {ladder('recency', [('Urgent — follow up this week', 14), ('Soon — follow up this month', 30)], 'Standard — include in next campaign', '<=')} AS follow_up_urgency
        FROM dimc WHERE segment IN ('New Customers', 'Promising', 'Potential Loyalists')""",
    "retention_mom": f"""
        SELECT yearmonth AS "Month", active AS "Active_Customers", kept AS "Retained_from_Prev_Month",
               {pct('kept', 'lag(active) OVER (ORDER BY m)', 1)} AS "Retention_Rate_%",
               active - lag(active) OVER (ORDER BY m) AS "Customer_Growth",
               CASE WHEN lag(m) OVER (ORDER BY m) <> m - 1 THEN 1 ELSE 0 END AS gap
        FROM mom""",
    "rfm_score_distribution": f"""
        SELECT r_score AS "R_Score", f_score AS "F_Score", m_score AS "M_Score", count(*) AS "Customers",
               {rnd(div('sum(monetary)', 'count(*)'), 0)} AS "Avg_Spend_GBP",
               {rnd(div('sum(recency)', 'count(*)'), 0)} AS "Avg_Recency_Days",
               {rnd(div('sum(frequency)', 'count(*)'), 1)} AS "Avg_Orders"
        FROM dimc GROUP BY ALL""",
    "clv_tiers": f"""
        SELECT {ladder('monetary', [('Platinum', 2000000), ('Gold', 1500000), ('Silver', 1000000), ('Bronze', 500000)], 'Standard')} AS "CLV_Tier",
               count(*) AS "Customers", {pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS "% of Base",
               {rnd('sum(monetary)', 0)} AS "Total_Revenue_GBP",
               {pct('sum(monetary)', 'sum(sum(monetary)) OVER ()', 1)} AS "% of Revenue",
               {rnd(div('sum(monetary)', 'count(*)'), 0)} AS "Avg_Spend_GBP",
               {rnd(div('sum(frequency)', 'count(*)'), 1)} AS "Avg_Orders"
        FROM dimc GROUP BY 1""",
    "segment_migration": f"""
        SELECT segment AS "Current_Segment",
               CASE {" ".join(f"WHEN segment = {text(s)} THEN {text(p)}" for s, p in UPGRADE_PATHS.items())} ELSE {text(NO_UPGRADE)} END AS "Path_to_Upgrade",
               count(*) AS "Customers", {rnd(div('sum(monetary)', 'count(*)'), 0)} AS "Avg_Current_Spend",
               {rnd(div('sum(CAST(avgordervalue AS DECIMAL(18,2)))', 'count(*)'), 0)} AS "Avg_Order_Value",
               {rnd(div('sum(CAST(avgordervalue AS DECIMAL(18,2))) * 2', 'count(*)'), 0)} AS "Est_Revenue_If_They_Return"
        FROM dimc WHERE segment NOT IN ('Champions', 'Loyal Customers') GROUP BY segment""",
    "monthly_revenue": f"""
        SELECT yearmonth AS "Month", monthname(min(InvoiceDate)) AS "Month_Name",
               year(min(InvoiceDate)) AS "Year", quarter(min(InvoiceDate)) AS "Quarter",
               {_ORDERS} AS "Total_Orders", {_BUYERS} AS "Unique_Customers", {rnd(_SUM, 0)} AS "Total_Revenue_GBP",
               {rnd(div(_SUM, 'count(*)'), 2)} AS "Avg_Line_Value", {rnd(div(_SUM, _ORDERS), 2)} AS "Avg_Order_Value_GBP",
               {_growth('yearmonth')} AS "MoM_Growth_%",
               {rnd(f'sum({_SUM}) OVER (ORDER BY yearmonth ROWS UNBOUNDED PRECEDING)', 0)} AS "Cumulative_Revenue_GBP"
        FROM sales GROUP BY yearmonth""",
    "quarterly_revenue": f"""
        SELECT d.yearquarter AS "Quarter", d.year AS "Year", d.quarter AS "Q", {_ORDERS} AS "Total_Orders",
               {_BUYERS} AS "Unique_Customers", {rnd(_SUM, 0)} AS "Total_Revenue_GBP",
               {rnd(div(_SUM, _ORDERS), 2)} AS "Avg_Order_Value_GBP", {_growth('d.yearquarter')} AS "QoQ_Growth_%"
        FROM sales JOIN dimd d ON CAST(InvoiceDate AS DATE) = d.datekey GROUP BY d.yearquarter, d.year, d.quarter""",
    "dow_pattern": f"""
        SELECT d.dayofweek AS "Day_Number", d.dayname AS "Day", d.isweekend AS "Is_Weekend",
               {_ORDERS} AS "Total_Orders", {_BUYERS} AS "Unique_Customers", {rnd(_SUM, 0)} AS "Total_Revenue_GBP",
               {rnd(div(f'sum({_SUM}) OVER ()', 'count(*) OVER ()'), 0)} AS "Daily_Avg_Revenue",
               {pct(_SUM, f'sum({_SUM}) OVER ()', 1)} AS "% of Total Revenue",
               {rnd(div(_SUM, _ORDERS), 2)} AS "Avg_Order_Value_GBP"
        FROM sales JOIN dimd d ON CAST(InvoiceDate AS DATE) = d.datekey GROUP BY d.dayofweek, d.dayname, d.isweekend""",
    "seasonality_index": f"""
        SELECT d.month AS "Month_Number", d.monthname AS "Month", {_ORDERS} AS "Total_Orders",
               {rnd(_SUM, 0)} AS "Total_Revenue_GBP", {rnd(div(_SUM, 'count(*)'), 2)} AS "Avg_Transaction_Value",
               {pct(_SUM, f'sum({_SUM}) OVER ()', 1)} AS "% of Annual Revenue",
               {pct(_SUM, div(f'sum({_SUM}) OVER ()', 'count(*) OVER ()'), 0)} AS "Seasonality_Index"
        FROM sales JOIN dimd d ON CAST(InvoiceDate AS DATE) = d.datekey GROUP BY d.month, d.monthname""",
    "country_ranking": f"""
        SELECT country AS "Country", isuk AS "Is_UK", revenuerank AS "Revenue_Rank", totalorders AS "Total_Orders",
               uniquecustomers AS "Unique_Customers", {dbl('totalrevenue')} AS "Total_Revenue_GBP",
               {pct('totalrevenue', 'sum(totalrevenue) OVER ()', 2)} AS "% of Total Revenue",
               avgordervalue AS "Avg_Order_Value_GBP",
               {rnd(div('totalrevenue', 'uniquecustomers'), 2)} AS "Revenue_per_Customer_GBP",
               CASE WHEN isuk = 1 THEN 'Home Market' WHEN totalrevenue >= 130000000 THEN 'Major Export Market'
                    WHEN totalrevenue >= 125000000 THEN 'Established Export'
                    WHEN avgordervalue > avg(avgordervalue) OVER () THEN 'Premium Small Market'
                    ELSE 'Emerging Market' END AS "Market_Classification"
        FROM dimg""",
    "top_products": f"""
        SELECT stockcode AS "Stock_Code", description AS "Product", {dbl('totalrevenue')} AS "Total_Revenue_GBP",
               {pct('totalrevenue', 'sum(totalrevenue) OVER ()', 2)} AS "% of Total Revenue",
               totalquantitysold AS "Units_Sold", avgunitprice AS "Avg_Price_GBP", uniquecustomers AS "Unique_Buyers",
               uniqueinvoices AS "Invoices_Appeared_In", {rnd('popularityscore * 100', 1)} AS "Popularity_%",
               {ladder('totalrevenue', [('Hero Product', 3000000), ('Strong Performer', 2500000), ('Solid Contributor', 2000000)], 'Standard')} AS "Product_Tier"
        FROM dimp WHERE description IS NOT NULL ORDER BY totalrevenue DESC, stockcode LIMIT 20""",
    "aov_trend": f"""
        SELECT yearmonth AS "Month", o AS "Orders", {rnd('r', 0)} AS "Revenue_GBP", {rnd('a', 2)} AS "Avg_Order_Value_GBP",
               {rnd('avg(a) OVER (ORDER BY yearmonth ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS "3M_Rolling_Avg_AOV",
               {rnd('a - avg(a) OVER ()', 2)} AS "AOV_vs_Average"
        FROM (SELECT yearmonth, {_ORDERS} AS o, {_SUM} AS r, {div(_SUM, _ORDERS)} AS a FROM sales GROUP BY yearmonth)""",
    "home_vs_international": f"""
        SELECT CASE WHEN g.isuk = 1 THEN 'Home' ELSE 'International' END AS "Market",
               {_BUYERS} AS "Customers", {_ORDERS} AS "Orders", {rnd(_SUM, 0)} AS "Revenue_GBP",
               {pct(_SUM, f'sum({_SUM}) OVER ()', 1)} AS "% of Revenue",
               {rnd(div(_SUM, _ORDERS), 2)} AS "Avg_Order_Value_GBP",
               {rnd(div(_SUM, _BUYERS), 2)} AS "Revenue_per_Customer_GBP"
        FROM sales JOIN dimg g ON sales.Country = g.country GROUP BY g.isuk""",
    "new_vs_returning": _split_report("units"),
    "new_vs_returning_by_order": _split_report("order_units"),
    "exec_summary": f"""
        SELECT {rnd(_SUM, 0)} AS "Total_Revenue_GBP", {_ORDERS} AS "Total_Orders", {_BUYERS} AS "Total_Customers",
               count(DISTINCT StockCode) AS "Total_Products", count(DISTINCT Country) AS "Countries_Served",
               {rnd(div(_SUM, _ORDERS), 2)} AS "Avg_Order_Value_GBP",
               {rnd(div(_SUM, _BUYERS), 2)} AS "Avg_Revenue_per_Customer_GBP",
               {stamp('min(InvoiceDate)')} AS "Data_From", {stamp('max(InvoiceDate)')} AS "Data_To",
               (SELECT count(*) FROM dimc WHERE segment = 'Champions') AS "Champion_Customers",
               (SELECT {pct("sum(monetary) FILTER (segment = 'Champions')", 'sum(monetary)', 1)} FROM dimc) AS "Champions_Revenue_%",
               (SELECT count(*) FROM dimc WHERE segment IN ('At Risk', 'Cannot Lose Them')) AS "At_Risk_Customers"
        FROM sales""",
    "rfm_scatter": f"""
        SELECT customerid, segment, recency, frequency,
               {rnd('CAST(monetary - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) * 200 + 10', 4)} AS size
        FROM dimc, (SELECT min(monetary) AS lo, max(monetary) AS hi FROM dimc)""",
    "rfm_heatmap": 'SELECT r_score AS "R_Score", '
    + ", ".join(
        rnd(div(f"sum(monetary) FILTER (f_score = {f})", f"count(*) FILTER (f_score = {f})"), 2) + f' AS "F{f}"'
        for f in range(1, 6)
    )
    + " FROM dimc GROUP BY r_score",
    "retention_heatmap": f"""
        SELECT cohort AS "CohortMonth", idx AS "CohortIndex", {rnd('retention', 4)} AS "Retention_%",
               avgrevenue AS "AvgRevenue" FROM ret WHERE idx <= 12""",
    "retention_curves": f"""
        SELECT cohort AS "CohortMonth", idx AS "CohortIndex", {rnd('retention', 4)} AS "Retention_%"
        FROM ret WHERE idx <= 12 AND cohort IN
            (SELECT cohort FROM ret WHERE idx <= 12 GROUP BY cohort HAVING count(*) >= 2)""",
    "retention_average_curve": f"""
        SELECT idx AS "CohortIndex", count(*) AS "Cohorts", {rnd('avg(retention)', 4)} AS "Avg_Retention_%"
        FROM ret WHERE idx <= 12 GROUP BY idx""",
    "rule_scatter": """
        SELECT rule_str, support, confidence, lift FROM name_rules ORDER BY md5('42:' || rule_str), rule_str LIMIT 500""",
    "rule_pair_bars": """
        SELECT CASE WHEN length(rule_str) > 35 THEN substr(rule_str, 1, 35) || '…' ELSE rule_str END AS rule_short,
               lift, strength
        FROM (SELECT * FROM pairs ORDER BY lift DESC, antecedents_str, consequents_str LIMIT 15)""",
    "rule_network_edges": "SELECT * FROM net",
    "rule_network_nodes": """
        SELECT node, count(*) AS degree FROM (SELECT source AS node FROM net UNION ALL SELECT target FROM net)
        GROUP BY node""",
}


def _words(sql: str) -> set[str]:
    return {w for w in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in sql).split()}


def _complete(select: str) -> str:
    """The select with the common table expressions it needs, in their order."""
    needed: set[str] = set()
    pending = _words(select) & CTES.keys()
    while pending:
        name = pending.pop()
        needed.add(name)
        pending |= (_words(CTES[name]) & CTES.keys()) - needed
    parts = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    lead = f"WITH {', '.join(parts)} " if parts else ""
    return f"{lead}SELECT * FROM ({select})"


_SELECTS["bucketed_segment_revenue"] = _SELECTS["verify_segment_revenue"]
_SELECTS["bucketed_champions"] = _SELECTS["champions_deep_dive"]

ORACLES: dict[str, str] = {name: _complete(select) for name, select in _SELECTS.items()}
