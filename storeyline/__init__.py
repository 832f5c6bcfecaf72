"""Plan-geometry analytics as DataFrame plans, with training-data operators in ``storeyline.llm``."""
