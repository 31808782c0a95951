"""Column functions: tokens, markers, volatile content, detection, images, prediction, guards."""
