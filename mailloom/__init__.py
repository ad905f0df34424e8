"""Mail and text analytics on Spark."""
