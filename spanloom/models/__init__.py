"""Stages that call a model: ports, budget, descriptions, labels, replay tests. Rows are chosen in Spark, calls are made on the driver."""
