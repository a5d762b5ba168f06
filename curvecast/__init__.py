"""curvecast: functional (curve) forecasting analytics as Spark jobs."""
