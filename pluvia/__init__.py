"""Spark-native radar nowcasting, forecast verification and analytics."""
