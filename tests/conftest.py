import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kwhrecon.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture
def sample_base(spark):
    """Seven invented base rows: two plain, a flagged pair of one client, a flagged row alone, a main row alone, a month apart."""
    rows = [
        (1, "neg-901", "2031-07-01", "81.0", "40000000000111", "Padaria Ipê", "Norte Luz", 12.25, "0.07",
         "2031-08-05", "Em aberto", 61.10, 0.417, 44.0, 105.1, 61.10, None, "Fatura"),
        (2, "neg-902", "2031-07-01", "82", "40000000000222", "Oficina Jatobá", "Sul Energia", 9.5, "0.05",
         "2031-08-06", "Pago", 72.20, 0.391, 51.5, 123.7, 72.20, None, "Contrato"),
        (3, "neg-903", "2031-09-01", "83", "40000000000111", "Padaria Ipê", "Norte Luz", 13.75, "0.07",
         "2031-10-05", "Em aberto", 66.30, 0.417, 47.2, 113.5, 66.30, None, "Fatura"),
        (4, "neg-904", "2031-07-01", "84", "40000000000333", "Mercado Cedro", "Norte Luz", 31.0, "0.11",
         "2031-08-07", "Pago", 15.05, 0.402, 10.1, 25.15, 15.05, "Agrupamento", "Regra interna"),
        (5, "neg-905", "2031-07-01", "85", "40000000000333", "Mercado Cedro", "Norte Luz", 29.0, "0.11",
         "2031-08-07", "Pago", 14.95, 0.402, 9.9, 24.85, 14.95, "Agrupamento", "Fatura"),
        (6, "neg-906", "2031-07-01", "86", "40000000000444", "Escola Angico", "Leste Força", 7.0, "0.09",
         "2031-08-08", "Pago", 33.00, 0.377, 20.0, 53.0, 33.00, "Agrupamento", "Contrato"),
        (7, "neg-907", "2031-09-01", "87", None, "Escola Angico", None, None, None,
         None, None, 5.5, 0.377, 2.0, 7.5, 5.50, None, "Contrato"),
    ]
    schema = ("row_id long, unit_id string, period string, uc string, doc string, client string, "
              "distributor string, consumed_credit double, contract_discount string, due_date string, "
              "status string, amount double, tariff double, cost_with_gd double, cost_without_gd double, "
              "savings double, group_flag string, source string")
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, schema).withColumn("src", F.lit(0))
