"""Document-layout and text-quality analytics as PySpark DataFrame operators."""
