"""demandloom: retail demand and supply analytics as composable Spark DataFrame operators."""
