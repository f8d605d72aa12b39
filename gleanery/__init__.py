"""gleanery: Spark jobs over tables and streams of captured web content.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver and no operator needs a whole group in one task.
"""
