"""Analytics operators, each a DataFrame -> DataFrame function.

* ``behavior``  overview, action counts, journey rates, D1 retention, 7-day
  repurchase, lifecycle segments, advice, segment users, campaign audience
* ``funnel``    behavior normalisation, user-item stages, loose / strict item
  funnels, rankings, look-back event funnels with drop-offs and advice
* ``recommend`` review statistics, candidates, scores, guardrails, reasons,
  commission, ranked recommendations, catalog inspection
* ``affiliate`` affiliate / merchant KPIs, daily product view, alerts,
  effective commission rates, content products
* ``rules``     rule-based diagnosis and opportunities over the KPIs
* ``sessions``, ``chains`` sessions by pauses, longest ordered chains of steps
* ``diff``      differences of two snapshots, with multiplicity
"""
