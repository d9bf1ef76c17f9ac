"""Inputs the registered queries derive from the test tables.

The tables hold no company names, feeds or finance markup, so each view shapes
whole tables into the form an operator needs. The text of a view is portable
SQL: Spark runs it over the parquet files, the oracle over its own views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ownerscope.session import dealt

VIEWS = {
    # documents with a leading sentence that mentions companies
    "v_text": """
select doc_id, source, concat(case doc_id % 12
    when 0 then 'today, shares of Apple Inc (NASDAQ: AAPL) rose. '
    when 1 then 'we met Microsoft Corporation, then JPMorgan Chase & Co. yesterday. '
    when 2 then 'analysts like $TSLA and NVDA stock. '
    when 3 then 'later, Berkshire Hathaway Inc. bought more of Bank of America Corp, sources said. '
    when 4 then 'both Siemens AG, and Toyota KK report revenue: $5B growth. '
    when 5 then 'Shares of Amazon.com Inc. fell. '
    when 6 then 'the CEO of Oracle, said Walmart''s revenue was up 12% on strong retail sales. '
    when 7 then 'a bank merged with Capital One Financial, then Big Tech and JPM, C and GS. '
    when 8 then 'Nvidia Corporation, NVIDIA Corp, and Nvidia Holdings Ltd, see risk of decline at $NVDA. '
    when 9 then 'they acquired Apple, and this company, it seems, is new. '
    when 10 then 'the founder of Meta Platforms Inc, and $META (NYSE: META), cloud data platform. '
    else '' end, text) as text
from documents""",
    # company names with suffixes and small typing errors
    "v_name": """
select p_partkey as name_id, concat(upper(substr(n, 1, 1)), substr(n, 2), case p_partkey % 13
    when 0 then ' Inc.' when 1 then ' Corp' when 2 then ', LLC' when 3 then ' GmbH' when 4 then ' Co., Ltd.'
    when 5 then ' Holdings Ltd' when 6 then ' Group plc' when 7 then ' AG' when 8 then ' Pte Ltd'
    when 9 then ' S.A.' when 10 then ' Technologies' when 11 then ' KK' else '' end) as name
from (select p_partkey, case p_partkey % 7
    when 0 then replace(p_name, 'g', 'gg') when 1 then replace(p_name, 'l', '')
    when 2 then concat('the ', p_name) when 3 then replace(p_name, ' ', '-')
    else p_name end as n from part) t""",
    # names close to the shipped companies
    "v_query": """
select p_partkey as query_id, concat(case p_partkey % 20
    when 0 then 'Apple Inc' when 1 then 'Aple Computers' when 2 then 'Microsft Corporation' when 3 then 'MSFT'
    when 4 then 'Google Inc.' when 5 then 'Alphabet' when 6 then 'Amazon.com' when 7 then 'Meta Platform'
    when 8 then 'Berkshire Hathaway Inc.' when 9 then 'JP Morgan Chase' when 10 then 'Wal-Mart Store'
    when 11 then 'Tesla Motor' when 12 then 'Nvidia Corp' when 13 then 'BRK.A' when 14 then 'facebook'
    when 15 then 'Chase Bank' when 16 then 'Apple' when 17 then 'The Tesla Company'
    when 18 then 'Walmart' else 'amzn' end,
    case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then concat(' ', p_type)
    else concat(' ', p_brand) end) as query
from part""",
    # ownership shares: grouped first, so the total per company runs over its owners only
    "v_owner": """
select company_id, owner_id,
       concat(case when owner_id % 29 = 0 then 'Test Fund ' when owner_id % 31 = 0 then 'Supplier/' else 'Supplier ' end,
              cast(case when company_id % 11 = 0 then owner_id % 5 else owner_id end as varchar(20))) as name,
       round(100.0 * amount / sum(amount) over (partition by company_id), 2) as pct, shares, seen_at
from (select l_partkey as company_id, l_suppkey as owner_id, sum(l_extendedprice) as amount,
             cast(sum(l_quantity) as bigint) as shares, max(l_shipdate) as seen_at
      from lineitem group by l_partkey, l_suppkey) t""",
    "v_contract": """
select concat('AWD-', lpad(cast(o_orderkey as varchar(20)), 9, '0')) as award_id,
       o_custkey as recipient_id, concat('Customer ', cast(o_custkey as varchar(20))) as recipient_name,
       o_totalprice as amount,
       case o_orderkey % 5 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' else 'E' end as award_type,
       case substr(o_orderpriority, 1, 1) when '1' then 'DEPARTMENT OF DEFENSE'
            when '2' then 'DEPARTMENT OF ENERGY' when '3' then 'DEPARTMENT OF HOMELAND SECURITY'
            when '4' then 'DEPARTMENT OF VETERANS AFFAIRS' else 'DEPARTMENT OF EDUCATION' end as agency,
       o_orderdate as start_date,
       case when o_orderkey % 97 = 0 then 'Classified systems support'
            when o_orderkey % 13 = 0 then 'Military logistics' else 'Office supplies' end as description
from orders""",
    "v_entity": """
select c_custkey as entity_id, c_custkey % 97 as group_id, c_name as name,
       case c_nationkey % 13 when 0 then 'ky' when 1 then 'us' when 2 then 'gb' when 3 then 'lu'
            when 4 then 'de' when 5 then 'fr' when 6 then 'bm' when 7 then 'jp' when 8 then 'sg'
            when 9 then 'ca' when 10 then 'vg' when 11 then 'au' else 'x1' end as jurisdiction,
       concat('C-', cast(c_custkey as varchar(20))) as company_number,
       case when c_acctbal < 0 then 'Dissolved' else 'Active' end as status,
       concat('Customer ', cast(c_custkey % 97 as varchar(20))) as term
from customer""",
    "v_series": """
select case o_orderpriority when '1-URGENT' then 'GDPC1' when '2-HIGH' then 'FEDFUNDS'
            when '3-MEDIUM' then 'PAYEMS' when '5-LOW' then 'DCOILWTICO' else 'NASDAQCOM' end as series_id,
       date_trunc('month', o_orderdate) as date, round(sum(o_totalprice), 2) as value
from orders group by 1, 2""",
    "v_article": """
select doc_id, doc_id % 40 as company_id, case doc_id % 8
    when 0 then 'Hedge fund increased stake by 5% in strong growth quarter'
    when 1 then 'Merger talks: shareholder sold $3 billion of shares'
    when 2 then 'Weak outlook, downgrade risk'
    when 3 then 'Board faces proxy fight with activist investor'
    when 4 then 'Dividend upgrade beats forecast'
    when 5 then 'Company opens office'
    when 6 then 'Institutional investor acquired 12.5% stake, pension fund sold 2 million'
    else 'Portfolio risk and profit decline' end as title, text as description,
  case when doc_id % 3 = 0 then 'reuters' else source end as source_id
from documents""",
    "v_request": "select user_id as requester, event_id, ts, event_type as action from events",
    "v_fetch": """
select case user_id % 7 when 0 then 'yahoo' when 1 then 'sec' when 2 then 'opencorporates' when 3 then 'usaspending'
            when 4 then 'fred' when 5 then 'news' else 'worldbank' end as source,
       event_id, ts, event_type <> 'error' and event_type <> 'view' as ok
from events""",
    # pages with finance hosts and markup in front of the article
    "v_page": """
select page_id, concat(case page_id % 9
    when 0 then 'https://finance.yahoo.com/quote/AAPL' when 1 then 'https://www.bloomberg.com/markets/company/apple'
    when 2 then 'https://www.marketwatch.com/investing/stock/TSLA' when 3 then 'https://www.forbes.com/companies/berkshire-hathaway/'
    when 4 then 'https://www.forbes.com/lists/global2000/companies/walmart' when 5 then 'https://www.marketwatch.com/story/latest-news'
    when 6 then 'https://www.bloomberg.com/opinion/articles' else url end, case when page_id % 9 < 7 then '?p=' else '' end,
    case when page_id % 9 < 7 then cast(page_id as varchar(20)) else '' end) as url,
  replace(html, '<article>', concat('<article>', case page_id % 9
    when 0 then '<section class="quote-header-section"><h1 data-symbol="AAPL">Apple Inc. (AAPL)</h1><span class="ticker-symbol">AAPL +1.25%</span></section><a href="/quote/MSFT">Microsoft Corporation</a><div class="js-stream-content"><h3>Tesla Inc. stock gains</h3></div>'
    when 1 then '<h1 class="headline">Nvidia Corp (NASDAQ: NVDA) rises</h1><span class="ticker">NVDA US Equity</span><div class="body-content"><p>Alphabet Inc. said cloud grew</p><p class="company-tag">JPMorgan Chase &amp; Co.</p></div><div class="quote-data">US0378331005</div>'
    when 2 then '<h1 class="article__headline">Tesla Inc. (TSLA:NASDAQ) falls</h1><a href="/investing/stock/F">Ford</a><div class="watchlist"><span class="watchlist__symbol">amzn</span></div><div class="markets__item"><span class="ticker">DJIA</span><span class="price">100.5</span><span class="change">1.5</span><span class="percent">1.5%</span></div><bg-quote symbol="META" field="last">300</bg-quote><div data-ticker="TSLA" data-last-price="250.1" data-change="2.5" data-change-percent="1.0" data-volume="1000">Tesla</div>'
    when 3 then '<h1 class="listuser-header__name">Berkshire Hathaway</h1><span data-section="money" class="section">Warren Buffett</span><time datetime="2024-01-05">Jan 5</time><div class="byline">Jane Roe</div>'
    when 4 then '<h3 class="listuser-block__title">Walmart Inc.</h3><span class="company-ticker">(NYSE:WMT)</span><p>revenue $5B, #1 on the list</p>'
    when 5 then '<h1 class="article__headline">Amazon.com Inc. shares fall</h1><div class="article__body"><p>The company said "it will grow"</p></div>'
    when 6 then '<div class="ad-container"><span class="ticker">MSFT</span></div><blockquote><p>Meta Platforms Inc. reported growth</p></blockquote>'
    else '' end)) as html
from pages""",
}

_TABLE = re.compile(r"\bfrom (documents|part|lineitem|orders|customer|supplier|events|pages|conversations)\b")


#: inputs whose rows take much work each
HEAVY = ("v_text", "v_article", "v_page")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame over the parquet files of ``sf_dir``; heavy ones are dealt as the caller says."""
    rows = _view(spark, sf_dir, name)
    return dealt(rows) if name in HEAVY else rows


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_TABLE.sub(lambda m: f"from parquet.`{sf_dir}/{m.group(1)}.parquet`", VIEWS[name]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*names: str) -> str:
    """The same inputs as common table expressions for the oracle."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)
