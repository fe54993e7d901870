"""tessera: document question-answering analytics and rule lookup on Spark DataFrames."""
