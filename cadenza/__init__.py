"""Timeline, mix and corpus analytics as Spark DataFrame operators."""
