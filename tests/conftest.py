import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # tests own their checkpoint folder; on a cluster it comes from the cluster's config
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="arrearscope-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def account_row(**over):
    """FIXTURES golden row; keyword overrides make edge rows."""
    base = dict(customer_id="G1", customer_name="Golden", due_date="01-01-2024", age=35, income=50000.0,
                loan_amount=500000.0, outstanding_amount=200000.0, emi_amount=15000.0, credit_score=700.0, dpd=45,
                missed_payment_count=2, previous_ptp_count=4, previous_ptp_kept_count=3, collection_attempts=8,
                successful_contacts=5, recent_payment_amount=5000.0, days_since_last_payment=30,
                preferred_channel="SMS")
    base.update(over)
    return base


def accounts_df(spark, rows):
    from arrearscope.schema import ACCOUNT
    return spark.createDataFrame([tuple(r[f.name] for f in ACCOUNT.fields) for r in rows], ACCOUNT)
