import datetime as dt


def _kpis(spark, rows):
    return spark.createDataFrame(rows, "evidence_id string, metric string, current double, previous double, "
                                       "absolute_change double, percent_change double")


def _cands(spark, rows):
    return spark.createDataFrame(rows, "evidence_id string, dimension string, segment string, "
                                       "rank_within_dimension int")


def _incidents(spark):
    return spark.createDataFrame([("gt_b", "b", dt.date(2024, 1, 9), "late cause", "r2"),
                                  ("gt_a", "a", dt.date(2024, 1, 2), "early cause", "r1")],
                                 "evidence_id string, incident_id string, incident_date date, root_cause string, "
                                 "resolution string")


def _texts(df):
    return {r.claim_id: (r.text, list(r.evidence_ids)) for r in df.collect()}


def test_campaign_and_traffic_claims(spark):
    from shiftscope.plans.claims import campaign_claims, traffic_claims
    k = _kpis(spark, [("cmp_1", "cpc", 2.0, 1.6, 0.4, 0.25)])
    c = _cands(spark, [("drv_1", "channel", "Google Ads", 1), ("drv_2", "channel", "Email", 2)])
    got = _texts(campaign_claims(k, c, _incidents(spark), "cpc"))
    assert got["campaign_metric_change"] == ("CPC changed by 25.0% versus the previous period.", ["cmp_1"])
    assert got["primary_driver"][0] == "The leading campaign driver was channel=Google Ads."
    assert got["campaign_recommendation"][0] == "Review channel=Google Ads and the inputs to CPC."
    assert got["campaign_incident"] == ("Investigate the documented cause: early cause.", ["gt_a"])
    k2 = _kpis(spark, [("trk_1", "sessions", 90.0, 100.0, -10.0, -0.1)])
    got = _texts(traffic_claims(k2, c, None, "sessions"))
    assert got["traffic_metric_change"][0] == "Sessions changed by -10.0% versus the previous period."
    assert "traffic_incident" not in got


def test_attribution_sentiment_claims(spark):
    from shiftscope.plans.claims import attribution_claims, sentiment_claims
    k = _kpis(spark, [("att_1", "attribution_completeness", 0.5, 0.8, -0.3, -0.375),
                      ("att_2", "unattributed_sessions", 40.0, 0.0, 40.0, None)])
    d = _cands(spark, [("atd_1", "campaign", "Unattributed", 1)])
    got = _texts(attribution_claims(k, d, None))
    assert got["attribution_completeness_change"][0] == "Attribution completeness changed by -37.5%."
    assert got["unattributed_session_change"][0] == "Unattributed sessions increased from 0 to 40."
    assert got["primary_driver"][0] == "The leading data-quality driver was campaign=Unattributed."
    k2 = _kpis(spark, [("rev_1", "negative_review_rate", 0.2, 0.1, 0.1, None)])
    t = _cands(spark, [("top_1", "topic", "payment/crash", 1)])
    got = _texts(sentiment_claims(k2, t, None))
    assert got["negative_review_rate_change"][0] == "The negative-review rate changed by n/a."
    assert got["review_recommendation"][0] == "Prioritize product diagnostics and support review for topic=payment/crash."


def test_experiment_claims(spark):
    from shiftscope.plans.claims import experiment_claims
    lift = spark.createDataFrame(
        [("Checkout copy", "exd_1", "exp_r", 0.137778, 0.097778, 0.04, True, 0.05)],
        "experiment_name string, evidence_id string, revenue_evidence_id string, treatment_rate double, "
        "control_rate double, absolute_conversion_lift double, statistically_significant boolean, "
        "revenue_per_user_percent_change double")
    got = {r.claim_id: r for r in experiment_claims(lift).collect()}
    assert got["experiment_conversion_lift"].text == (
        "Treatment conversion rate was 13.8% versus 9.8% for control, a 4.0% absolute lift that was "
        "statistically significant.")
    assert got["experiment_revenue_lift"].evidence_ids == ["exp_r"]
    assert got["experiment_decision"].report == "experiment:Checkout copy"
