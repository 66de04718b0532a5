"""Text, similarity and quality functions, as Columns wherever Spark can express them."""
